"""The entities' schemas; nothing is inferred."""

from __future__ import annotations

SECTION = "struct<title:string,text:string>"
PAPER = "pmid string, doi string, title string, journal string, authors array<string>, mesh_terms array<string>, published_at date, full_text string"
ARTICLE = f"pmid string, pmcid string, doi string, title string, journal string, authors array<string>, abstract array<{SECTION}>, body array<{SECTION}>"
CHUNK = "chunk_id string, pmid string, section string, position int, char_start int, char_end int, content string, hq_questions array<string>"
EMBEDDED = CHUNK + ", embedding array<double>"
QA_PAIR = "qa_id string, pmid string, question string, prompting_strategy string, relevant_chunk_ids array<string>"
RETRIEVAL = "variant string, qa_id string, rank int, chunk_id string, score double"
RETRIEVAL_RESULT = "qa_id string, retrieved_ids array<string>, scores array<double>, rewritten_query string, latency_ms int, tokens_used int"
POOL = "qa_id string, pos int, chunk_id string"
JUDGE_LABEL = "qa_id string, chunk_id string, judge_a int, judge_b int, final int"
PER_QUERY = "variant string, qa_id string, n_gold int, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double"
COMPARISON = "a string, b string, metric string, mean_a double, mean_b double, statistic double, p_value double, significant boolean"
RUN_METRICS = "recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double, avg_latency_ms double, avg_tokens double"
RUN = f"run_id string, variant string, config map<string,string>, started_at timestamp, finished_at timestamp, metrics struct<{', '.join(f.replace(' ', ':') for f in RUN_METRICS.split(', '))}>"
HUMAN_CSV = "qa_id string, chunk_id string, question string, chunk_text string, human_relevant string"
EXPERT_CSV = "nr string, qa_id string, chunk_id string, frage string, textausschnitt string, relevant string, kommentar string"

VARIANTS = {"baseline": (False, False), "qr_only": (False, True), "hq_only": (True, False), "both": (True, True)}
"""variant: (enriched collection, rewritten query)"""
STRATEGIES = ("direct", "conversational", "clinical")
