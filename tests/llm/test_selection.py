"""Importance resampling, decontamination and the divergence audit against plain versions of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import decontamination, divergence, importance
from skerry.llm._arrow import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rank string, weight string, item string, words string, term string"
VOCABULARY = ["the", "of", "Ärger", "ça", "X1", "42", "Σίσυφος", "ΟΔΟΣ", "node", "alpha", "beta", "naïve", "q" * 40, "İstanbul", "z"]
GAPS = [" ", "  ", "\n", ", ", " - ", "\u007f", ". ", "/", "’ "]


def text_of(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice(GAPS) for _ in range(n))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def upper(text):
    return "".join(c.upper() if "a" <= c <= "z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    long = [text_of(rng, n) for n in (12, 25, 40, 10, 11)]
    return [*enumerate(long), (5, "node alpha 42"), (6, ""), (7, None), (8, " ?! "), (9, long[0]), (9, text_of(rng, 30)), (None, "beta, beta; ΟΔΟΣ z of naïve"), (10, long[1][:60])]


@pytest.fixture(scope="module")
def rows(items):
    """Nulls, empty and long texts, passages of items, repeated rows, rows without an identifier, columns with clashing names."""
    rng = random.Random(3)
    texts = [text_of(rng, rng.randint(1, 60)) for _ in range(60)]
    for k in range(12):
        item = items[k % 5][1]
        texts.append(text_of(rng, rng.randint(0, 9)) + upper(item) + text_of(rng, rng.randint(0, 9)))
        texts.append(text_of(rng, 8) + " ".join(words_of(item)[2:13]) + " " + text_of(rng, 4))
        texts.append(" ".join(words_of(item)[1:10]))  # one word short of a window
    texts += [None, "", " \n", "?", "one", "node  ALPHA\n42", text_of(rng, 9000) + items[1][1] + text_of(rng, 300), "w" * 5000 + " " + "v" * 300 + " of"]
    out = [(i, t, ["en", "de", None, "en"][i % 4], [None, "a", "b", "ä", "a", ""][i % 6], i, i % 3, "r", "w", "i", "s", "t") for i, t in enumerate(texts)]
    return [*out, out[61], out[61], (None, texts[62], None, None, None, None, None, None, None, None, None), (None, "again", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def test_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- importance resampling ---------------------------------------------------------------------------


def features_of(text, run=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def expected_scores(rows, target, run=2, buckets=10_000, seed=7):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = Counter(bucket(f) for r in rows for f in features_of(r[1], run)), Counter(bucket(f) for r in target for f in features_of(r[1], run))
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))

    out = []
    for r in rows:
        f = features_of(r[1], run)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(words_of(r[1])), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize(("run", "chunk_bytes", "buckets"), [(2, 1 << 16, 10_000), (2, 50, 10_000), (1, 7, 97), (4, 64, 1000)])
def test_importance_scores(docs, test_items, rows, items, run, chunk_bytes, buckets):
    found = importance.scored(docs, test_items, run=run, chunk_bytes=chunk_bytes, buckets=buckets).select("doc_id", "n_words", "n_features", "weight", "score")
    assert ordered(map(tuple, found.collect())) == ordered(expected_scores(rows, items, run, buckets))


def test_importance_ranks(docs, test_items, rows, items):
    found = [tuple(r) for r in importance.ranked(docs, test_items).select("doc_id", "score", "rank").collect()]
    able = [(r[0], r[4]) for r in expected_scores(rows, items) if r[1] >= 20]
    draw = len(able) * 25 // 100
    best = sorted(able, key=lambda r: (-r[1], r[0] is None, r[0]))[:draw]
    assert draw > 3
    assert [(d, s) for d, s, _ in sorted((r for r in found if r[2] is not None), key=lambda r: r[2])] == best
    assert sorted(r[2] for r in found if r[2] is not None) == list(range(1, draw + 1))
    assert len(found) == len(rows)


def test_importance_draws_rows(docs, test_items, nothing, spark, rows, items):
    drawn = importance.drawn(docs, test_items)
    assert drawn.columns == docs.columns
    able = [r for r in rows if len(words_of(r[1])) >= 20]
    assert drawn.count() == len(able) * 25 // 100
    single = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ranks = importance.ranked(single, test_items).filter("rank is not null")
    assert {r["doc_id"] for r in importance.drawn(single, test_items).collect()} == {r["doc_id"] for r in ranks.collect()}
    assert importance.ranked(nothing, test_items).count() == 0 and importance.drawn(nothing, test_items).count() == 0
    flat = importance.scored(docs, spark.createDataFrame([], "item_id long, text string"))
    assert flat.count() == len(rows)


def test_crc_of_words_and_runs():
    texts = [b"a bc  d" + b"e" * 33 + b" " + b"f" * 5000 + b" g", b"", "é ü ".encode() * 3, b"x"]
    words = Words(texts, separators=importance.SEPARATORS)
    spelled = [words.raw[a:b] for a, b in zip(words.starts, words.ends)]
    assert importance.word_crcs(words).tolist() == [zlib.crc32(w) for w in spelled]
    owned = np.ones(len(spelled), dtype=bool)
    of = np.repeat(np.arange(len(texts)), words.counts)
    for k, (first, crc) in enumerate(importance.features(words, owned, 3)):
        want = [(i, zlib.crc32(b" ".join(spelled[i : i + k + 1]))) for i in range(len(spelled) - k) if of[i] == of[i + k]]
        assert list(zip(first.tolist(), crc.tolist())) == want


# --- decontamination -----------------------------------------------------------------------------------


def expected_hits(text, items, n=10):
    w = words_of(text)
    covered, named = set(), set()
    for item, body in items:
        v = words_of(body)
        size = min(n, len(v))
        windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1) if windows else ():
            if tuple(w[k : k + size]) in windows:
                covered |= set(range(k, k + size))
                named.add("" if item is None else str(item))
    return covered, named


def expected_findings(rows, items, n=10):
    out = []
    for r in rows:
        covered, named = expected_hits(r[1], items, n)
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((r[0], len(words_of(r[1])), len(covered), len(named), digest, bool(covered)))
    return out


@pytest.mark.parametrize(("n", "piece", "broadcast"), [(10, 4096, 1_000_000), (10, 7, 0), (3, 5, 1_000_000), (13, 64, 0)])
def test_contamination(docs, test_items, rows, items, n, piece, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "BROADCAST_RUNS", broadcast)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    found = decontamination.findings(docs, test_items, n)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = expected_findings(rows, items, n)
    assert 5 < sum(r[5] for r in want) < len(want) - 5
    assert ordered(map(tuple, found.collect())) == ordered(want)


def test_contaminated_documents_and_spans_go(docs, test_items, rows, items, nothing, spark):
    clean = decontamination.without_documents(docs, test_items)
    assert clean.columns == docs.columns
    want = [r for r in rows if not expected_hits(r[1], items)[0]]
    assert ordered(map(tuple, clean.collect())) == ordered(want)
    cut = decontamination.without_spans(docs, test_items)
    assert cut.columns == docs.columns and cut.count() == len(rows)

    def remaining(text):
        covered, _ = expected_hits(text, items)
        return [w for k, w in enumerate(words_of(text)) if k not in covered]

    got = Counter((r["doc_id"], tuple(words_of(r["text"])), r["n_chars"]) for r in cut.collect())
    assert got == Counter((r[0], tuple(remaining(r[1])), r[4]) for r in rows)
    untouched = {r[0]: r[1] for r in want if r[0] is not None}
    assert all(r["text"] == untouched[r["doc_id"]] for r in cut.collect() if r["doc_id"] in untouched)
    assert decontamination.findings(nothing, test_items).count() == 0
    none = decontamination.findings(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)


def test_scan_stays_in_the_jvm(docs, test_items):
    plan = decontamination.findings(docs, test_items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- divergence ------------------------------------------------------------------------------------------


def expected_audit(rows, least_docs=10, top=10):
    texts = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, w in texts:
        groups.add((lang, source))
        seen[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        by = {s: share(counts[lang, s]) for s in sources}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = sorted(((-sum(far(by[s][t], by[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-far(by[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and by[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])]
    return out


@pytest.mark.parametrize(("least_docs", "block", "held"), [(10, 65_536, 200_000), (1, 3, 2), (4, 20, 200_000), (10_000, 65_536, 200_000)])
def test_divergence(docs, rows, least_docs, block, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    found = divergence.audit(docs, least_docs=least_docs, block_entries=block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == sorted(expected_audit(rows, least_docs))


def test_divergence_of_few_rows(spark, nothing):
    assert divergence.audit(nothing).count() == 0
    one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.audit(one).count() == 0  # one source has no pair
    two = spark.createDataFrame([("", "x", "a"), (None, "x", "b"), ("?", "x", None)], "text string, lang string, source string")
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in divergence.audit(two).collect()) == [("", "a", 0, 1), ("", "b", 0, 2), ("a", "", 0, 1), ("a", "b", 0, 2), ("b", "", 0, 1), ("b", "a", 0, 2)]


def test_slices_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    texts = [b"ab cd ab xyzxyzxyz e", b"", "xyzxyzxyz éééééé abababababab cd xyzxyzxyq".encode()]
    words = Words(texts, separators=divergence.SEPARATORS)
    spelled = [words.raw[a:b] for a, b in zip(words.starts, words.ends)]
    for hashed in (lambda b: 1, len, lambda b: b[0] % 2):
        monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", hashed)
        of, terms = divergence.grouped(words)
        assert [terms[k] for k in of] == spelled and len(set(of.tolist())) == len(set(spelled))


def test_shares_of_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randint(1, 8 * 10**15)
        count, kept = rng.randint(0, total), rng.randint(1, 10**6)
        assert divergence.shares(np.array([count]), np.int64(total), kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_blocks_hold_a_bounded_number_of_counts(docs):
    rows = docs.select(F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k"), "text", "lang", "source").drop("k")
    whole, small = (sorted(map(tuple, divergence.audit(rows, block_entries=b).collect())) for b in (1 << 20, 5))
    assert whole == small
