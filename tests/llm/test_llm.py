import datetime
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import brown, chat, exact_dedup, licenses, matroska, mixing, packing, pseudonyms, quality, simhash
from skerry.llm.components import connected_components
from skerry.llm.templates import TEMPLATES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, label string"
SYLLABLES = ["the", "on", "er", "ing", "ou", "ä", "que", "st"]


def text_of(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0].replace(" ", "\t"), " " + texts[1] + "\n", texts[2], None, "", " \n", "x", text_of(rng, 6000), texts[3] + " end", "Émile 'S <|end|> \\ <\\|text|>"]
    out = [(i, t, "en", [None, "a", "b", "ä", "a"][i % 5], len(t or ""), i % 2, "d", "l") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append((len(r[1] or ""), -r[0] if r[0] is not None else -math.inf, r[0]))
    return {k: (max(v)[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    digest = (lambda n: F.length(n) % 7) if weak else exact_dedup.sha256_digest
    got = exact_dedup.exact_dedup(docs, digest=digest, files_per_trigger=1).collect()
    want = expected_groups(rows)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_keep_first(docs, rows, nothing):
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(k for k, _ in expected_groups(rows).values())
    assert exact_dedup.keep_first(nothing).count() == exact_dedup.exact_dedup(nothing).count() == 0


def test_brown(docs, rows, nothing):
    model = brown.train(docs, own_units=20, classes=6, head_words=50)
    got = brown.score(docs, model).collect()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")), None] for r in rows]
    count = Counter(t for ts in tokens for t in ts)
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], len(ts), round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for r, ts in zip(rows, tokens))
    assert Counter((r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == n for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert np.allclose((10.0**model.transition).sum(1), 1)
    assert brown.score(nothing, model).count() == 0
    assert all(r["n_known"] == 0 for r in brown.score(docs, brown.train(nothing)).collect())


def test_brown_classes_from_use(spark):
    """Words without units of their own that end alike but are used differently come apart, however rare."""
    rng = random.Random(9)
    pick = lambda kind: rng.choice([f"{kind}x", f"{kind}{rng.randint(0, 60)}zz"])
    texts = [" ".join(w for _ in range(20) for w in ("ga", pick("p"), "gb", pick("q"))) for _ in range(20)]
    model = brown.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own_units=4, classes=6, head_words=20)
    found = {r["key"]: r["class"] for r in model.counts.collect()}
    of = lambda kind: {found[int(k)] for k in brown.word_keys(brown.Words([" ".join({w for t in texts for w in t.split() if w[0] == kind and w.endswith("zz")}).encode()]))}
    assert len(of("p")) == len(of("q")) == 1 and of("p") != of("q")


def test_brown_single_moves():
    """A word's best class by itself is the one that brute force finds."""
    rng = np.random.default_rng(3)
    classes, units = 4, 12
    pairs, label = rng.integers(0, 6, (units, units)), rng.integers(0, classes, units)

    def table(labels):
        member = np.eye(classes)[labels]
        return member.T @ pairs @ member

    def value(labels):
        t = table(labels)
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    own = np.diag(pairs).astype(float)
    rest = pairs - np.diag(np.diag(pairs))
    got = brown.best_classes(table(label), rest @ np.eye(classes)[label], rest.T @ np.eye(classes)[label], own, label)
    assert got.tolist() == [int(np.argmax([value(np.where(np.arange(units) == w, c, label)) for c in range(classes)])) for w in range(units)]


def test_exchange_finds_classes():
    """Words of two kinds that always alternate end up apart."""
    pairs = np.zeros((8, 8), dtype=np.int64)
    for a in range(8):
        for b in range(8):
            pairs[a, b] = 50 if a % 2 != b % 2 else 0
    label = brown.exchange(pairs, classes=2)
    assert len({label[k] for k in range(0, 8, 2)}) == len({label[k] for k in range(1, 8, 2)}) == 1 and label[0] != label[1]


def test_licenses(spark, nothing):
    body = TEMPLATES["mit-text"]
    cut = body.split()
    texts = {
        1: "x y " + TEMPLATES["apache-2.0"] + " z", 2: "a b c", 3: None, 4: "", 5: "foo " * 300 + body + " bar" * 50, 6: " ".join(cut[: len(cut) // 2]),
        7: " ".join([*cut[:30], "edited", *cut[31:]]), 8: TEMPLATES["mit"].upper(), 9: "released under the mit", 10: "software permission license",
    }
    data = [(k, t, "x", 0) for k, t in texts.items()]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string, license string, row int")).collect()}
    assert got == {(1, "apache-2.0"), (5, "mit-text"), (7, "mit-text"), (8, "mit")}
    assert licenses.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(nothing, {"short": "all rights reserved"})


def test_license_notices(spark, nothing):
    """Texts of fewer than five words are found word for word, however they are spaced."""
    texts = ["x (c) ALL  Rights\nreserved! a all rights reserved", "overall rights reserved", "all rights are reserved", "All rights reserved.", "all rights", None, "", "All rights reserved."]
    data = spark.createDataFrame([(k if k != 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["containment"], r["first_word"], r["n_windows"]) for r in licenses.scan(data).collect()}
    assert got == {(0, "all-rights-reserved", 1.0, 2, 2), (3, "all-rights-reserved", 1.0, 0, 1), (None, "all-rights-reserved", 1.0, 0, 1)}
    got = licenses.scan(data, notices={"one": "RIGHTS", "two": "rights are"}).collect()
    assert sorted((r["license"], r["first_word"]) for r in got if r["doc_id"] in (2, 4)) == [("one", 1), ("one", 1), ("two", 1)]
    for wrong in ({"none": "?"}, {"long": "one two three four five"}, {"mit": "all rights"}):
        with pytest.raises(ValueError):
            licenses.scan(nothing, notices=wrong)


def test_mixing(docs, rows, nothing):
    mix = mixing.Mix(docs, block_words=8)
    got = mix.taken().collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goal = {r["source"]: r["target"] for r in mix.sources.collect()}
    assert sum(goal.values()) == pytest.approx(sum(size.values())) and all(goal[s] <= 3 * size[s] + 1e-9 for s in size)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)
    took = Counter()
    for r, source in ((r, r2["source"]) for r in got for r2 in [next(x for x in mix.sources.collect() if x["source_size"] == r["source_size"] and x["target"] == r["target"])]):
        took[source] += r["taken"]
    assert all(abs(took[s] - goal[s]) <= 16 for s in size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.Mix(docs, block_words=8).taken().collect()), key=str)
    assert mixing.Mix(nothing).taken().count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents(docs, rows):
    plain = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = mixing.mixed_documents(plain, block_words=8)
    assert got.columns == docs.columns
    texts = {r[0]: r[1] for r in rows}
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(plain, block_words=8).taken().collect()}
    words = Counter()
    for r in got.collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_mixed_documents_of_one_identifier(spark):
    """Rows that share an identifier, or have none, get their own runs."""
    rng = random.Random(8)
    texts = [text_of(rng, 40) for _ in range(6)]
    data = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[1], "a"), (None, texts[2], "a"), (None, texts[3], "b"), (2, texts[4], "b"), (3, None, "b"), (3, texts[5], "a")]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mixed_documents(table, block_words=8).collect()
    words = Counter()
    for r in got:
        assert any(r["text"] in t for i, t, s in data if t and (i, s) == (r["doc_id"], r["source"]))
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    size = Counter()
    for _, t, s in data:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = dict(zip("ab", mixing.targets([size["a"], size["b"]], [1, 2])))
    assert all(abs(words[s] - goal[s]) <= 16 for s in "ab")


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r["p"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_targets():
    assert mixing.targets([10, 1, 100], [1, 2, 3]) == pytest.approx([27.0, 3.0, 81.0])
    assert mixing.targets([0, 5], [1, 2]) == pytest.approx([0.0, 5.0])


def test_quality(spark, docs, rows, nothing):
    rng = random.Random(1)
    data = [(i, text_of(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in text_of(rng, 60).split())) for i in range(300)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(9999, 1), (1, None)], "doc_id long, quality int")
    trees = quality.train(table, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(table, trees).collect()}
    assert all((scored[i] >= 0.3) == (i % 3 > 0) for i in range(300))
    assert len(quality.score(docs, trees).collect()) == len(rows) and quality.score(nothing, trees).count() == 0
    kept = quality.keep_good(table, trees)
    assert kept.columns == table.columns and kept.count() == 200
    assert {r["score"] for r in quality.score(table, quality.train(table, labels.limit(0))).collect()} == {0.5}


def walked(trees, text):
    """The score of one text, node by node."""
    x, raw = quality.statistics([text])[0], trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        k = 0
        while k < len(f):
            k = 2 * k + 1 + int(x[f[k]] > t[k])
        raw += v[k - len(f)]
    return 1 / (1 + math.exp(-raw))


def test_trees_flat_equals_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    trees = quality.fit(np.pad(x, ((0, 0), (0, len(quality.FEATURES) - 5))), y, trees=10)
    row = np.pad(x[7], (0, len(quality.FEATURES) - 5))
    raw = trees.base
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        k = 0
        while k < len(f):
            k = 2 * k + 1 + int(row[f[k]] > t[k])
        raw += v[k - len(f)]
    assert trees.score(row[None, :])[0] == pytest.approx(1 / (1 + math.exp(-raw)))


def test_media(docs, rows, nothing):
    got = Counter((r["doc_id"], r["payload_sha256"], r["tail_crc32"]) for r in matroska.media_columns(docs).collect())
    want = Counter()
    for r in rows:
        payload = matroska.padded((r[1] or "").encode())
        assert len(payload) % 192 == 0 and payload
        want[r[0], hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert got == want and matroska.media_columns(nothing).count() == 0


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacing(lacing):
    frames = [b"a" * n for n in ((192, 192, 192) if lacing == 2 else (1, 255, 510, 3, 0, 700))]
    body = matroska.block_body(3, -2, frames, lacing)
    cluster = matroska._element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 10) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, body)))
    data = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster
    found = matroska.packets(data)
    assert [data[p.start : p.start + p.size] for p in found] == frames and {(p.track, p.timestamp) for p in found} == {(3, 8)}


def test_media_cues_and_damage(spark):
    media = matroska.mux(matroska.padded(b"x" * 100_000))
    points = matroska.cues(media)
    assert len(points) == 3 and all(media[p[2] : p[2] + 4] == matroska._id(matroska.CLUSTER) for p in points)
    table = matroska.packet_table(spark.createDataFrame([(1, bytearray(media)), (2, bytearray(media[:-5])), (3, None)], "file_id long, data binary"))
    assert {r["file_id"]: r["error"] is None for r in table.collect()} == {1: True, 2: False}


PII = {
    1: "mail ann.bee+x@mail.example.com or call +1 (212) 555-0187 now", 2: "card 4539 1488 0343 6467 and 4539148803436467, not 4539148803436468",
    3: "on 2024-02-29, 29.02.2024 or 02/29/2024; not 2023-02-29", 4: "ip 10.20.30.40 but 999.1.1.1", 5: "ssn 123-45-6789 not 000-45-6789", 6: None, 7: "", 8: "plain 12 text", 9: "again 10.20.30.40",
}


def test_pseudonyms(spark, nothing):
    data = spark.createDataFrame([(k, t, "x", "y") for k, t in PII.items()], "doc_id long, text string, found string, values string")
    got = {r["doc_id"]: r for r in pseudonyms.findings(data, "k").collect()}
    kinds = {k: [f["kind"] for f in r["found"]] for k, r in got.items()}
    assert kinds == {1: ["email", "phone"], 2: ["card", "card"], 3: ["date"] * 3, 4: ["ipv4"], 5: ["ssn"], 9: ["ipv4"]}
    cards = [re.sub("[^0-9]", "", f["pseudonym"]) for f in got[2]["found"]]
    assert cards[0] == cards[1] != "4539148803436467" and "4539148803436468" in got[2]["text"]
    digits = [int(c) for c in cards[0]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert got[4]["found"] == got[9]["found"] and "999.1.1.1" in got[4]["text"]
    assert "000-45-6789" in got[5]["text"] and "2023-02-29" in got[3]["text"]
    assert re.fullmatch(r"mail [a-z0-9.+]{9}@mail\.example\.com or call \+1 \(\d{3}\) \d{3}-\d{4} now", got[1]["text"].replace("@", "@")) and "ann.bee" not in got[1]["text"]
    assert pseudonyms.findings(nothing, "k").count() == 0


VALID = {
    "ssn": lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000",
    "date": lambda v: date_of(v) is not None, "ipv4": lambda v: all(int(x) < 256 for x in v.split(".")),
    "card": lambda v: luhn(re.sub("[^0-9]", "", v)) and not v.startswith("000000"), "phone": lambda v: True, "email": lambda v: "@" in v,
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def date_of(v):
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            return datetime.datetime.strptime(v, form).date()
        except ValueError:
            pass


def test_pseudonyms_stay_valid(spark):
    """Every pseudonym is a valid value of its kind and notation, and different values have different ones."""
    rng = random.Random(12)
    days = [datetime.date.fromordinal(rng.choice([rng.randint(1, 693_595), rng.randint(693_596, 766_495), rng.randint(766_496, 3_652_059)])) for _ in range(400)]
    days += [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), datetime.date(1900, 1, 1), datetime.date(1899, 12, 31), datetime.date(2099, 8, 5), datetime.date(2099, 8, 6), datetime.date(9883, 9, 28)]
    late = [d for d in days if d.day > 12] + [datetime.date(y, 2, 29) for y in (4, 400, 1600, 1604, 2000, 2024, 9996)]
    values = {f"{d.year:04d}-{d.month:02d}-{d.day:02d}" for d in days} | {f"{d.day:02d}.{d.month:02d}.{d.year:04d}" for d in days}
    values |= {f"{d.month:02d}/{d.day:02d}/{d.year:04d}" for d in days} | {f"{d.day:02d}/{d.month:02d}/{d.year:04d}" for d in late}
    values |= {f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(600)} | {"001-01-0001", "899-99-9999", "667-01-0001", "665-99-9999"}
    values |= {".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(300)} | {f"192.168.{a:03d}.{b:02d}" for a in range(0, 40) for b in range(10)} | {"0.0.0.0", "255.255.255.255", "192.168.001.010", "192.168.1.10"}
    cards = ["".join(str(rng.randint(0, 9)) for _ in range(n)) for n in range(12, 19) for _ in range(60)]
    cards = {c + next(d for d in "0123456789" if luhn(c + d)) for c in cards}
    values |= cards | {f"{c[:4]} {c[4:10]} {c[10:]}" for c in cards if len(c) in (14, 15)} | {f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}" for c in cards if len(c) == 16}
    table = spark.createDataFrame([(v,) for v in sorted(values)], "v string").repartition(4)
    got = table.select("v", pseudonyms.kind_of(F.col("v")).alias("kind")).withColumn("p", pseudonyms.pseudonym(F.col("v"), F.col("kind"), "secret"))
    got = got.withColumn("again", pseudonyms.kind_of(F.col("p"))).collect()
    assert len(got) == len(values) and all(r["kind"] for r in got)
    for r in got:
        assert r["again"] == r["kind"] and VALID[r["kind"]](r["p"]), r
        assert [c if not c.isdigit() else "0" for c in r["p"]] == [c if not c.isdigit() else "0" for c in r["v"]] or r["kind"] == "ipv4", r
    assert len({r["p"] for r in got}) == len(got)
    # Month first and day first can't be mistaken for each other.
    for r in got:
        if r["kind"] == "date" and "/" in r["v"]:
            assert (int(r["v"][:2]) > 12) == (int(r["p"][:2]) > 12), r


def test_small_feistel_domains(spark):
    """All of a domain, in and out: days of a span up to the 12th and later ones, padded octets."""
    first, last = datetime.date(pseudonyms.YEARS[1], 1, 1), datetime.date(pseudonyms.YEARS[2] - 1, 12, 31)
    days = [datetime.date.fromordinal(k) for k in range(first.toordinal(), last.toordinal() + 1)]
    late, early = ({f"{d:%d/%m/%Y}" for d in days if (d.day > 12) == after} for after in (True, False))
    padded = {f"{a:02d}.0{b:02d}.7.{c}" for a in range(10) for b in range(0, 100, 9) for c in (0, 9, 255)}
    for values, closed in ((late, True), (early, True), (padded, False)):
        table = spark.createDataFrame([(v,) for v in sorted(values)], "v string").repartition(4)
        got = {r["p"] for r in table.select(pseudonyms.pseudonym(F.col("v"), pseudonyms.kind_of(F.col("v")), "k").alias("p")).collect()}
        assert got == values if closed else len(got) == len(values) and all(re.fullmatch(r"0\d\.0\d\d\.\d+\.\d+", p) for p in got)


def test_one_day_in_all_notations(spark):
    """A day has one pseudonym, whatever its notation; numbers of days and their days, over all years."""
    rng = random.Random(8)
    days = [datetime.date.fromordinal(rng.randint(1, 3_652_059)) for _ in range(500)] + [datetime.date(2024, 12, 25), datetime.date(2024, 6, 5), datetime.date(1, 1, 1), datetime.date(9999, 12, 31)]
    days += [datetime.date(y, m, d) for y in (4, 1900, 1901, 2000, 2095, 2096, 2100, 9996) for m, d in ((1, 12), (1, 13), (2, 28), (3, 13), (12, 31))]
    forms = {"%Y-%m-%d": "{0.year:04d}-{0.month:02d}-{0.day:02d}", "%d.%m.%Y": "{0.day:02d}.{0.month:02d}.{0.year:04d}", "%m/%d/%Y": "{0.month:02d}/{0.day:02d}/{0.year:04d}", "%d/%m/%Y": "{0.day:02d}/{0.month:02d}/{0.year:04d}"}
    asked = [(d.isoformat(), form, written.format(d)) for d in set(days) for form, written in forms.items() if form != "%d/%m/%Y" or d.day > 12]
    table = spark.createDataFrame(asked, "day string, form string, v string").repartition(4)
    got = {}
    for r in table.select("day", "form", pseudonyms.pseudonym(F.col("v"), F.lit("date"), "k").alias("p")).collect():
        got.setdefault(r["day"], set()).add(datetime.datetime.strptime(r["p"], r["form"]).date())
    assert len(got) == len(set(days)) and all(len(g) == 1 for g in got.values())
    for day, (new,) in got.items():
        span = [sum(y <= int(d[:4]) for y in pseudonyms.YEARS) for d in (day, f"{new.year:04d}")]
        assert span[0] == span[1] and (int(day[8:]) > 12) == (new.day > 12)


def test_pseudonyms_of_long_and_repeated_rows(spark):
    """Long texts, repeated rows, texts with the mark itself; the key isn't in the plan."""
    long = "word 12 " * 30_000 + "ssn 123-45-6789 " + "x" * 50_000 + " a.b@c.de"
    marked = "\x01 \x01\x01 123-45-6789 \x01 a.b@c.de\x01"
    table = spark.createDataFrame([(1, long), (2, long), (2, long), (3, marked), (4, "123-45-6789")], "doc_id long, text string")
    found = pseudonyms.findings(table, "a secret key")
    got = [(r["doc_id"], r["text"], tuple(r["found"])) for r in found.collect()]
    assert "a secret key" not in found._jdf.queryExecution().toString()
    assert len(got) == 5 and len({g[1:] for g in got if g[0] < 3}) == 1
    ssn, mail = (dict(got[0][2])[k] for k in ("ssn", "email"))
    assert dict([g[::2] for g in got if g[0] == 4][0][1]) == {"ssn": ssn}
    by = {g[0]: g[1] for g in got}
    assert by[1] == long.replace("123-45-6789", ssn).replace("a.b@c.de", mail) and by[3] == marked.replace("123-45-6789", ssn).replace("a.b@c.de", mail)


def brute_findings(text):
    """(kind, value) of a text by the patterns alone, with Python's regular expressions and calendar."""
    out = []
    for m in re.finditer(pseudonyms.PATTERN, text or ""):
        v = m.group()
        digits = re.sub("[^0-9]", "", v)
        if "@" in v:
            out.append(("email", v))
        elif re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d([./])\d\d\1\d{4}", v):
            out += [("date", v)] * (date_of(v) is not None)
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}", v):
            out += [("ssn", v)] * VALID["ssn"](v)
        elif re.fullmatch(pseudonyms.PHONE, v):
            out.append(("phone", v))
        elif re.fullmatch(r"[0-9 -]+", v):
            out += [("card", v)] * (13 <= len(digits) <= 19 and luhn(digits) and not digits.startswith("000000"))
        else:
            out += [("ipv4", v)] * VALID["ipv4"](v)
    return out


def test_pseudonyms_against_brute_force(spark):
    """Findings of random texts are those of the patterns, and only they are replaced."""
    rng = random.Random(21)
    parts = ["4539 1488 0343 6467", "4539148803436468", "378282246310005", "3782 822463 10005", "10.1.2.3", "1.2.3.999", "01.002.3.4", "2024-02-30", "31.12.1999", "12/31/1999", "31/12/1999", "13/13/1999",
             "+1 (212) 555-0187", "212-555-0187", "123-45-6789", "666-45-6789", "a_b%c@d-e.co.uk", "x@y", "12", "word", "7.", "-", "é", ",", "1234-56-78901", "\x01"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", ", ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pseudonyms.findings(table, "k").collect()}
    want = {k: f for k, t in enumerate(texts) if (f := brute_findings(t))}
    assert {k: [f["kind"] for f in r["found"]] for k, r in got.items()} == {k: [kind for kind, _ in f] for k, f in want.items()}
    same = {}
    for k, f in want.items():
        at = 0
        for (kind, value), new in zip(f, got[k]["found"]):
            assert same.setdefault((kind, value.lower()), new["pseudonym"]) == new["pseudonym"]
        # Between the findings the text is as it was.
        for piece in re.split("|".join(sorted({re.escape(n["pseudonym"]) for n in got[k]["found"]}, key=len, reverse=True)), got[k]["text"]):
            found_at = texts[k].find(piece, at)
            assert found_at >= at or any(n["pseudonym"] in texts[k] for n in got[k]["found"])
            at = max(found_at, at)


def test_feistel_permutes(spark):
    got = [r["p"] for r in spark.range(72).select(pseudonyms.feistel(F.col("id"), F.lit(8).cast("long"), F.lit(9).cast("long"), "k", "t").alias("p")).collect()]
    assert sorted(got) == list(range(72))
    got = [r["p"] for r in spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p")).collect()]
    assert len(set(got)) == 1000 and all(len(p) == 3 for p in got)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(points, distance=4):
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    points = list(parent)
    for i, a in enumerate(points):
        for b in points[:i]:
            if bin(a ^ b).count("1") <= distance:
                parent[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_simhash(docs, rows, nothing):
    prints = [fingerprint(r[1]) for r in rows]
    root = components_of(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    want = Counter((r[0], p if p < 1 << 63 else p - (1 << 64), least.get(root[p])) for r, p in zip(rows, prints))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*least.values(), None}
    assert simhash.near_duplicates(nothing).count() == simhash.keep_representatives(nothing).count() == 0


@pytest.mark.parametrize("groups, hot_cell", [(None, 1 << 20), (8, 1 << 20), (6, 16)])
def test_near_links_keep_components(spark, groups, hot_cell):
    rng = random.Random(3)
    points = set()
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(60):
            points.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    points |= {rng.getrandbits(64) for _ in range(60)}
    signed = [(p if p < 1 << 63 else p - (1 << 64),) for p in points]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), groups=groups, hot_cell=hot_cell)
    found = {r["node"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
    want = components_of(points)
    assert len({found.get(p, p) for p in points}) == len(set(want.values()))
    same = defaultdict(set)
    for p in points:
        same[want[p]].add(found.get(p, p))
    assert all(len(v) == 1 for v in same.values())


def pieces_of(rows, sequence):
    """Pieces of (doc_id, text) rows, by the tokenizer alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), sequence):
            yield doc_id, k, len(ids[k : k + sequence]), zlib.crc32(ids[k : k + sequence].tobytes()), len(ids)


def test_packing(docs, rows, nothing):
    got = packing.pack_documents(docs, TOKENIZER, sequence=256).collect()
    want = Counter(pieces_of(rows, 256))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


def test_encoder_equals_tokenizer():
    rng = random.Random(7)
    texts = ["It's 12 o'clock'd!!", "ÀÉß straße ſ İ ﬁ", "a b\u0085c", "<|endoftext|> x", "", "", "漢字 and мир", "é é", "don't'll '''s !'s", "\x00a \x1cb", "日本　語", "'", "x" * 70_000 + "'s", "a 🏆 b🏆 🏆"]
    letters = [*"aBstdm'''’12²½ÉßÞþ×÷ÿµª¡-!._  \n\t\x0b\x1c\x7f\x85\xa0\xadİſŽé中あ가🏆Σ٣Ⅷ", "re", "ve", "ll", "é", "<|endoftext|>", "</w>"]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    work = packing.TextEncoder(TOKENIZER)
    ids, bounds = work.encode([t.encode() for t in texts])
    assert len(bounds) == len(texts) + 1
    for text, start, end in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[start:end].tolist() == [*work.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_patterns():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(12)}
        packs = packing.patterns(histogram, 64)
        used = Counter()
        for lengths, count in packs:
            assert sum(lengths) <= 64
            for length in lengths:
                used[length] += count
        assert used == histogram


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|text|>", "<\\|end|>", "<\\\\|x", None, "", "a\nb", "$1 \\ <|", "<"]
    data = [(c, t, ["user", "assistant", "system", None, "<|text|>"][(c + t) % 5], odd[(2 * c + t) % len(odd)], "x") for c in range(6) for t in range(c + 1)]
    data += [data[3], (None, 1, "assistant", "orphan", "x"), (8, None, "assistant", "no turn", "x")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    render = chat.rendered(table)
    groups = defaultdict(list)
    for c, t, role, text, _ in data:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(render).collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = {r["conv_id"]: r["formatted"] for r in render.collect()}
    for r in chat.examples(render).collect():
        assert formatted[r["conv_id"]][r["loss_start"] : r["loss_end"]] == r["reply"]
    assert chat.example_texts(render).count() == sum(t[1] == "assistant" for g in groups.values() for t in g)
    assert chat.digests(chat.rendered(table.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    folder = tmp_path / "sf"
    plain = [r[:5] for r in rows if r[0] is not None]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in text_of(random.Random(i), 50).split()), "en", "a", 0) for i in range(60)]
    good = [(2000 + i, text_of(random.Random(500 + i), 50), "en", "b", 0) for i in range(60)]
    spark.createDataFrame([*plain, *junk, *good], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] >= 2000), 0) for r in [*junk, *good]], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    ids = {r["doc_id"] for r in got}
    assert len(ids & {r[0] for r in good}) >= 50 and not ids & {r[0] for r in junk}
    sequences = Counter()
    for r in got:
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= packing.SEQUENCE
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality", "exact_dedup", "near_dedup", "mixing", "packing"]'

    # Every stage against brute force on its own input.
    given = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(str(folder / "documents.parquet")).collect()]
    table, outs = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(folder))
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        outs.append(table.collect())
    rated, single, apart, mixed, packed = outs
    labels = spark.read.parquet(str(folder / "labels.parquet")).filter(~quality.in_fold(F.col("doc_id"), 0))
    trees = quality.train(spark.read.parquet(str(folder / "documents.parquet")), labels)
    assert Counter(r["doc_id"] for r in rated) == Counter(i for i, t, _ in given if walked(trees, (t or "").encode()) >= quality.THRESHOLD)
    assert Counter(r["doc_id"] for r in single) == Counter(k for k, _ in expected_groups([(r["doc_id"], r["text"]) for r in rated]).values())
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in single}
    root, least = components_of(prints.values()), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(r["doc_id"] for r in apart) == sorted(least.values())

    def n_words(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    texts, size, took, per = {r["doc_id"]: r["text"] for r in apart}, Counter(), Counter(), Counter()
    for r in apart:
        size[r["source"]] += n_words(r["text"])
    for r in mixed:
        assert r["text"] in texts[r["doc_id"]]
        took[r["source"]] += n_words(r["text"])
        per[r["doc_id"]] += n_words(r["text"])
    order = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    goal = dict(zip(order, mixing.targets([size[x] for x in order], [1 + k % 3 for k in range(len(order))])))
    assert all(abs(took[x] - goal[x]) <= 2 * 256 for x in order) and all(per[i] <= 3 * n_words(t) for i, t in texts.items())
    assert Counter(pieces_of([(r["doc_id"], r["text"]) for r in mixed], packing.SEQUENCE)) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
