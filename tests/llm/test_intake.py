"""Deduplication over several calls, held against all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.llm import dedup_intake

SCHEMA = "doc_id long, text string, key string, digest string, call string"


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def expected(calls, last):
    """(doc_id, keep_id, group_size, keep_call) of the last call's rows."""
    groups = {}
    for number in range(last + 1):
        for doc_id, text in calls[number]:
            groups.setdefault(squeezed(text), []).append((-len(text or ""), doc_id is not None and -1, doc_id or 0, number, doc_id))
    out = []
    for doc_id, text in calls[last]:
        best = min(groups[squeezed(text)])
        out.append((doc_id, best[4], len(groups[squeezed(text)]), best[3]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", "d", "c") for i, t in rows], SCHEMA).repartition(2)


@pytest.mark.parametrize("weak", [False, True])
def test_calls_go_on(spark, tmp_path, weak):
    """Nulls, empty and long texts, repeated rows, a weak digest whose texts meet within and across calls."""
    digest = (lambda n: F.length(n) % 5) if weak else dedup_intake.sha256_digest
    rng, state = random.Random(3), str(tmp_path / "state")
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "b a", "x" * 20_000, "é", *(str(k) for k in range(12))]
    calls = [[(rng.randint(0, 60), rng.choice(texts)) for _ in range(40)] for _ in range(3)]
    calls[1] += [calls[0][0], calls[0][0], (None, "ab")]
    calls.append([])
    for number, rows in enumerate(calls):
        got = dedup_intake.continued(table(spark, rows), state, number, digest=digest, files_per_trigger=1).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["keep_call"]) for r in got), key=str) == expected(calls, number)
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got if r["keep_call"] == number})


def test_a_call_counts_once(spark, tmp_path, monkeypatch):
    """A call that failed between its intake and its state, or between its contents and its intake, goes on; a repeated one changes nothing."""
    state, rows = str(tmp_path / "state"), [(1, "a"), (2, "a "), (3, "b")]
    first = sorted(map(tuple, dedup_intake.continued(table(spark, rows), state, 0).collect()))
    assert sorted(map(tuple, dedup_intake.continued(table(spark, rows), state, 0).collect())) == first

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(dedup_intake, "_run", lost)
        with pytest.raises(RuntimeError, match="lost"):
            dedup_intake.continued(table(spark, [(4, "a"), (5, "c")]), state, 1)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup_intake.continued(table(spark, [(4, "a"), (5, "c")]), state, 1).collect()}
    assert got == {4: (2, 3), 5: (5, 1)}

    (tmp_path / "state" / "contents").joinpath("call-000000002").mkdir()
    table(spark, [(6, "zzz")]).select("digest", F.lit("zzz").alias("key"), F.lit("zzz").alias("norm")).write.mode("overwrite").parquet(f"{state}/contents/call-000000002")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup_intake.continued(table(spark, [(6, "zzz"), (7, "c")]), state, 2).collect()}
    assert got == {6: (6, 1), 7: (5, 2)}
    with pytest.raises(ValueError, match="numbered"):
        dedup_intake.continued(table(spark, rows), state, -1)
