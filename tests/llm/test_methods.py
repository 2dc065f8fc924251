"""Operators against plain versions of their methods."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skerry.llm import brown, chat, exact_dedup, licenses, matroska, mixing, packing, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- exact dedup ------------------------------------------------------------------------------------


@pytest.mark.parametrize("texts", [["ab", "cd", "ab"], ["ab", "c d", "cd", "", None, " ", "abc", "xyz", "xyz"]])
def test_texts_of_one_digest_are_told_apart(spark, monkeypatch, texts):
    """Even when both digests collide, texts decide."""

    def weak(text):
        return F.length(text).cast("string")

    monkeypatch.setattr(exact_dedup, "sha256_digest", weak)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    squeezed = {k: re.sub(r"[\x20\x09-\x0D]", "", t or "") for k, t in enumerate(texts)}
    want = {}
    for k in squeezed:
        same = [j for j in squeezed if squeezed[j] == squeezed[k]]
        want[k] = (min(same, key=lambda j: (-len(texts[j] or ""), j)), len(same))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(table, digest=weak).collect()}
    assert got == want
    kept = exact_dedup.keep_first(table, digest=weak).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({k for k, _ in want.values()})


# --- Brown ------------------------------------------------------------------------------------------


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_brown_score(spark):
    """Scores follow from the classes of words by counting, also for words and classes outside the head."""
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "w0 w0 w0", "W1\tw2"]
    held = [*texts, "unseen w1 other unseen", "w79 w78"]
    table = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").repartition(3)
    model = brown.train(table.filter(F.col("doc_id") < len(texts)), own_units=10, classes=5, head_words=25)
    known = {r["key"]: (r["n"], r["class"]) for r in model.counts.collect()}

    def key(word):
        return int(brown.word_keys(brown.Words([word.encode()]))[0])

    end = int(model.label[model.units.end])

    def class_of(word):
        if word is None:
            return end
        spelling = int(brown.spellings(brown.Words([word.encode()]))[0])
        return known[key(word)][1] if key(word) in known else int(model.label[len(model.units.keys) + spelling])

    count = Counter(t for x in texts for t in [*words_of(x), None])
    pairs, size, distinct = Counter(), Counter(), Counter()
    for x in texts:
        before = end
        for t in [*words_of(x), None]:
            pairs[before, class_of(t)] += 1
            size[class_of(t)] += 1
            before = class_of(t)
    for t in count:
        distinct[class_of(t)] += 1
        assert t is None or known[key(t)][0] == count[t]
    total = sum(size.values())
    leaving = Counter()
    for (a, _), n in pairs.items():
        leaving[a] += n

    def log_of(before, t):
        c = class_of(t)
        share = (size[c] + 1) / (total + 5)
        return math.log10((pairs[before, c] + share) / (leaving[before] + 1)) + math.log10((count[t] + 0.5) / (size[c] + 0.5 * (distinct[c] + 1)))

    got = {r["doc_id"]: r for r in brown.score(table, model).collect()}
    for k, x in enumerate(held):
        value, before = 0.0, end
        for t in [*words_of(x), None]:
            value += log_of(before, t)
            before = class_of(t)
        assert got[k]["score"] == pytest.approx(value, abs=1e-8)
        assert got[k]["n_known"] == sum(t in count for t in [*words_of(x), None])


def test_brown_merging_of_contexts():
    """Contexts that come in several batches, and a word that comes in very many, count as one."""
    rng = np.random.default_rng(5)
    key, place, n = rng.integers(0, 4, 500), rng.integers(0, 6, 500), rng.integers(1, 9, 500)
    want = Counter()
    for k, p, m in zip(key, place, n):
        want[int(k), int(p)] += int(m)
    a, b, c = brown._merged(key, place, n)
    assert dict(zip(zip(a.tolist(), b.tolist()), c.tolist())) == want and sorted(want) == list(zip(a.tolist(), b.tolist()))
    assert [len(x) for x in brown._merged(key[:0], place[:0], n[:0])] == [0, 0, 0]


# --- licenses ---------------------------------------------------------------------------------------


def brute_containment(text, template):
    """(best share, its first shingle, windows that hold enough) by looking at every window."""
    of = lambda t: [tuple(w[k : k + 5]) for w in [re.findall(r"[a-z0-9]+", (t or "").lower())] for k in range(len(w) - 4)]
    want, have = set(of(template)), of(text)
    n = len(of(template))
    stride = max(1, n // 4)
    found = []
    for start in range(0, len(have), stride):
        share = len(want & set(have[start : start + n + stride - 1])) / len(want)
        if share >= 0.8:
            found.append((share, start))
    return None if not found else (max(s for s, _ in found), min(k for s, k in found if s == max(x for x, _ in found)), len(found))


def test_licenses_against_brute_force(spark):
    rng = random.Random(17)
    vocabulary = [f"term{k}" for k in range(40)] + ["the", "of", "license", "software"]
    templates = {f"t{n}": " ".join(rng.choices(vocabulary, k=n)) for n in (5, 6, 9, 24, 61, 140)}
    texts = [None, "", "one two", *templates.values()]
    for _ in range(250):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(list(templates.values())).split()
            if rng.random() < 0.3:
                words = words[rng.randint(0, len(words) // 3) :]
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(["edited", "", rng.choice(vocabulary)])
            parts += [", ".join(words) if rng.random() < 0.2 else " ".join(words).upper(), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        texts.append("\n".join(parts))
    texts.append(" ".join(["filler"] * 30_000 + [templates["t61"]] + ["filler"] * 30_000))
    data = [*enumerate(texts), (4, texts[4]), (None, texts[5])]
    want = Counter()
    for k, t in data:
        for name, template in templates.items():
            if f := brute_containment(t, template):
                want[k, name, round(f[0], 9), f[1], f[2]] += 1
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["license"], round(r["containment"], 9), r["first_word"], r["n_windows"]) for r in licenses.scan(table, templates).collect())
    assert len(want) > 150 and got == want


def test_many_license_templates(spark, monkeypatch):
    """More templates than words are searched for: found all the same, by a broadcast and by a shuffled join, and no plan grows with them."""
    rng = random.Random(5)
    templates = {f"t{k}": " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(6, 40))) for k in range(900)}
    assert len(licenses.anchors(templates)) > licenses.MOST_ANCHORS
    data = [(k, f"before it {templates[f't{k * 7}']} after") for k in range(100)] + [(200, "nothing of them"), (201, None)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for bound in (licenses.BROADCAST_SHINGLES, 0):
        monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", bound)
        monkeypatch.setattr(licenses, "BROADCAST_STARTS", bound)
        found = licenses.scan(table, templates)
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
        got = {(r["doc_id"], r["license"]) for r in found.collect() if r["containment"] == 1}
        assert got >= {(k, f"t{k * 7}") for k in range(100)} and {d for d, _ in got} == set(range(100))


# --- mixing -----------------------------------------------------------------------------------------


def test_small_sources_stay_in_the_mix(spark):
    """Sources of less than a block are taken, and columns of any name are kept."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"x{rng.randint(0, 9)}" for _ in range(rng.randint(1, 20))), f"s{k:02d}", "run", 5) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, runs string, size int")
    mix = mixing.Mix(table, block_words=32)
    taken = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    assert all(0 < taken[k] <= 3 * len(t.split()) for k, t, *_ in rows)
    mixed = mixing.mixed_documents(table, block_words=32)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        assert r["text"] in rows[r["doc_id"]][1] and (r["runs"], r["size"], r["source"]) == ("run", 5, rows[r["doc_id"]][2])
        words[r["doc_id"]] += len(r["text"].split())
    assert dict(words) == taken


def test_taken_words_by_brute_force(spark):
    """What each document gives follows from the blocks of its source and the slots that map to them."""
    rng = random.Random(16)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 7, 40, 300]))), rng.choice(["a", "a", "a", "b", None])) for k in range(60)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block_words=16)
    sources = {r["source_ix"]: r for r in mix.sources.collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))])))
    times = Counter((r["source_ix"], r["block"]) for r in mix.slots.collect())
    for ix, s in sources.items():
        blocks = -(-size[s["source"]] // 16)
        counts = [times[ix, b] for b in range(blocks)]
        assert s["target"] == pytest.approx(goal[s["source"]]) and set(b for i, b in times if i == ix) <= set(range(blocks))
        assert sum(counts) == max(1, round(goal[s["source"]] * blocks / size[s["source"]])) and max(counts) - min(counts) <= 1
    starts = {r["doc_id"]: (r["source_ix"], r["start"], r["size"]) for r in mix.documents.collect()}
    for ix in sources:  # documents fill their source without gaps
        at = 0
        for start, n in sorted((a, n) for i, a, n in starts.values() if i == ix):
            assert start == at or n == 0
            at += n
    for r in mix.taken().collect():
        ix, start, n = starts[r["doc_id"]]
        assert r["taken"] == sum(times[ix, w // 16] for w in range(start, start + n))


# --- Matroska ---------------------------------------------------------------------------------------


def el(identifier, *body):
    """An element as bytes: identifier in hexadecimal digits, size of one or two bytes, body."""
    body = b"".join(bytes.fromhex(x) if isinstance(x, str) else x for x in body)
    return bytes.fromhex(identifier) + (bytes([0x80 | len(body)]) if len(body) < 127 else (0x4000 | len(body)).to_bytes(2, "big")) + body


def media_file(cue_body=None, open_cluster=False):
    head = bytes.fromhex("1A45DFA3 84 42868101".replace(" ", ""))
    info = el("1549A966", el("2AD7B1", "07A120"))  # a tick is half a millisecond
    tracks = el("1654AE6B", el("AE", el("D7", "02"), el("23E383", "1E8480")), el("AE", el("D7", "03")))  # two milliseconds; none
    blocks = [
        el("E7", "0064"),
        el("A3", "82 0004 84 02".replace(" ", ""), b"abcdef"),  # fixed lacing, three frames
        el("A0", el("A1", "83 FFFE 02 01 01".replace(" ", ""), b"xyz"), el("9B", "06")),  # Xiph, two frames, six ticks
        el("A0", el("A1", "83 000A 00".replace(" ", ""), b"q"), el("FB", "FF")),
        el("A3", "83 0014 06 02 82 C0".replace(" ", ""), b"mmnnno"),  # EBML, three frames
    ]
    cluster = bytes.fromhex("1F43B675 01FFFFFFFFFFFFFF".replace(" ", "")) + b"".join(blocks) if open_cluster else el("1F43B675", *blocks)
    at = f"{len(info) + len(tracks):02X}"
    points = el("BB", el("B3", "64"), el("B7", el("F7", "02"), el("F1", at)), el("B7", el("F7", "03"), el("F1", at))) if cue_body is None else el("BB", cue_body)
    segment = bytes.fromhex("18538067 01FFFFFFFFFFFFFF".replace(" ", ""))
    return head + segment + info + tracks + cluster + el("1C53BB6B", points), len(head) + len(segment) + len(info) + len(tracks)


@pytest.mark.parametrize("open_cluster", [False, True])
def test_frames_of_a_file_written_by_hand(open_cluster):
    data, cluster = media_file(open_cluster=open_cluster)
    found = matroska.packets(data)
    assert [data[p.start : p.start + p.size] for p in found] == [b"ab", b"cd", b"ef", b"x", b"yz", b"q", b"mm", b"nnn", b"o"]
    assert [p.track for p in found] == [2, 2, 2, 3, 3, 3, 3, 3, 3] and [p.lacing for p in found] == [2, 2, 2, 1, 1, 0, 3, 3, 3]
    assert [p.timestamp for p in found] == [104, 108, 112, 98, 101, 110, 120, 120, 120]
    assert [p.time_ns for p in found] == [52_000_000, 54_000_000, 56_000_000, 49_000_000, 50_500_000, 55_000_000] + [60_000_000] * 3
    assert [p.key for p in found] == [True, True, True, True, True, False, False, False, False]
    assert matroska.cues(data) == [(100, 2, cluster), (100, 3, cluster)]


@pytest.mark.parametrize("body", [el("B3", "64"), el("B7", el("F7", "02"), el("F1", "10")), el("B3", "64") + el("B7", el("F7", "02"))])
def test_damaged_cues(body):
    with pytest.raises(ValueError):
        matroska.cues(media_file(body)[0])


def test_written_frames_follow_each_other(spark):
    """Frames of 4 ms come back 4 ms apart, over laces, blocks and clusters."""
    payload = matroska.padded(b"frame " * 20_000)
    media = matroska.mux(payload)
    found = matroska.packets(media)
    assert [p.timestamp for p in found] == [4 * k for k in range(len(payload) // 192)] == [p.time_ns // 1_000_000 for p in found]
    head, _ = media_file()
    table = matroska.packet_table(spark.createDataFrame([(1, bytearray(media)), (2, bytearray(b"")), (3, bytearray(head[:-3])), (4, bytearray(head[:10]))], "file_id long, data binary")).collect()
    rows = defaultdict(list)
    for r in table:
        rows[r["file_id"]].append(r)
    assert len(rows[1]) == len(found) and 2 not in rows and rows[3][0]["error"] and sorted(r["time_ns"] for r in rows[1])[1] == 4_000_000


def test_media_columns_by_brute_force(spark):
    """Features and digests of the stored form."""
    import hashlib
    import json

    rng = random.Random(3)
    texts = [None, "", "x", "é" * 96, "é" * 97, "".join(chr(rng.randint(32, 900)) for _ in range(70_000))]
    for r in matroska.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(r["media"])) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        middle = [b - 128 for b in payload]
        assert json.loads(r["feature"]) == {
            "packets": len(payload) // 192, "tracks": 1, "ms": 4 * (len(payload) // 192 - 1), "cues": -(-len(payload) // (192 * 256)), "sum": sum(payload), "energy": sum(m * m for m in middle),
            "crossings": sum((a >= 0) != (b >= 0) for a, b in zip(middle, middle[1:])), "first": sum(m * m for m in middle[:192]), "last": sum(m * m for m in middle[-192:]), "spread": len(set(payload)),
        }


# --- near duplicates --------------------------------------------------------------------------------


def test_representatives_with_any_columns(spark):
    table = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 7, 8), (3, "entirely different words here now", 7, 8)], "doc_id long, text string, gone_id int, GONE_ID_ int")
    kept = simhash.keep_representatives(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_one_component_of_many(spark, monkeypatch):
    """A component that holds most fingerprints, with hot cells cut into blocks and joins without broadcasts."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: docs.select("doc_id", F.col("n").alias("fp")))
    chain = [(1 << k) - 1 for k in range(0, 64, 3)]
    wide = [sum(1 << b for b in bits) for bits in [(0,), (1,), (2,), (0, 1), (0, 2), (5, 9), (7,), (40, 41, 42)]]
    prints = sorted({*chain, *wide, 0x5555_0000_1234_0FF0, 0x7AAA_FFFF_0000_FFFF})
    signed = [p if p < 1 << 63 else p - (1 << 64) for p in prints]
    table = spark.createDataFrame([(100 - k, p) for k, p in enumerate(signed)], "doc_id long, n long")
    parent = {p: p for p in prints}

    def root(p):
        return p if parent[p] == p else root(parent[p])

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, p in enumerate(prints):
        least[root(p)] = min(100 - k, least.get(root(p), 1000))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table, hot_cell=8).collect()}
    assert got == {100 - k: least[root(p)] for k, p in enumerate(prints)}


# --- packing ----------------------------------------------------------------------------------------


def test_packing_wastes_little(spark):
    """Sequences are nearly full, and a caller's columns aren't overwritten."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "naïve"]) for _ in range(rng.choice([1, 5, 30, 200, 900]))) for _ in range(300)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    tokens, sequences = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert sequences <= -(-tokens // packing.SEQUENCE) * 1.05 + 1
    with pytest.raises(ValueError):
        packing.pack(packing.token_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path).withColumn("_rank", F.lit(1)))


# --- chat -------------------------------------------------------------------------------------------


def test_examples_against_brute_force(spark):
    """Contexts and masks are those of the preceding turns; the digest is of what the masks cut out."""
    rng = random.Random(23)
    bits = ["hi", "é", "<|end|>", "<|turn|>assistant<|text|>", "<\\|text|>", "<", "|>", "\\", "</s>[INST] ok [/INST]", "𝒳", "\n", "<|"]
    data = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<|end|>", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 6)))])) for c in range(30) for t in range(rng.randint(1, 8))]
    data += [(99, t, ["user", "assistant"][t % 2], "long reply " * 200) for t in range(300)]
    render = chat.rendered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).cache()
    escape = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x or "")
    want = []
    for c in {d[0] for d in data}:
        before = ""
        for _, t, role, text in sorted(d for d in data if d[0] == c):
            if role == "assistant":
                want.append((c, before + "<|turn|>assistant<|text|>", escape(text)))
            before += f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>"
        assert render.filter(F.col("conv_id") == c).first()["formatted"] == before
    got = chat.example_texts(render).collect()
    assert Counter((r["conv_id"], r["context"], r["reply"]) for r in got) == Counter(want)
    formatted = {r["conv_id"]: r["formatted"] for r in render.collect()}
    for r in chat.examples(render).collect():
        whole = formatted[r["conv_id"]]
        assert whole[r["loss_start"] : r["loss_end"]] == r["reply"] == whole.encode()[r["first_byte"] : r["end_byte"]].decode()
        assert whole[r["loss_end"] :].startswith(chat.END)


@pytest.mark.parametrize("column, by", [("first_byte", 1), ("end_byte", -1), ("end_byte", 7)])
def test_a_wrong_mask_shows(spark, column, by):
    data = [(1, 0, "user", "question"), (1, 1, "assistant", "answer"), (2, 0, "assistant", "other")]
    render = chat.rendered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    right = {r["conv_id"]: r["loss_sha256"] for r in chat.digests(render).collect()}
    shifted = chat.examples(render).withColumn(column, F.col(column) + by)
    wrong = {r["conv_id"]: r["loss_sha256"] for r in chat.digests(render, shifted).collect()}
    assert all(right[k] != wrong[k] for k in (1, 2))
    assert "Window" in chat.digests(render)._jdf.queryExecution().toString()


def doubled(length):
    """A word of a and b and its complement, which polynomials modulo a power of two don't tell apart from 1,024 letters on."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [64, 512, 1024, 2048, 8192])
def test_brown_long_words_are_told_apart(spark, length):
    a, b = doubled(length)
    table = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {a}")], "doc_id long, text string")
    model = brown.train(table)
    assert (model.distinct, model.tokens) == (3, 7)
    got = {r["doc_id"]: r["base_score"] for r in brown.score(table, model).collect()}

    def log(n):
        return math.log10((n + 0.5) / (7 + 0.5 * 4))

    assert got == pytest.approx({0: log(3) + log(3), 1: log(1) + log(3), 2: 2 * log(3) + log(3)})


def test_brown_counts_anew_where_words_share_a_key(spark, monkeypatch):
    import pyarrow as pa

    counting = brown._count_words

    def weak(salt):
        def run(batches):
            for batch in counting(salt)(batches):
                key = pa.array(np.asarray(batch.column("key")) % (2 if salt < 3 else 2**62))
                yield batch.set_column(0, "key", key)

        return run

    monkeypatch.setattr(brown, "_count_words", weak)
    counts, salt = brown._counted(spark.createDataFrame([("a b c d e a",), ("f a",)], "text string"))
    assert salt == 3 and sorted(r["n"] for r in counts.collect()) == [1, 1, 1, 1, 1, 3]


def test_brown_keys_of_a_slice_are_compared(monkeypatch):
    import pyarrow as pa

    table = brown._table
    monkeypatch.setattr(brown, "_table", lambda salt: np.ones(256, dtype=np.uint64) if salt == 0 else table(salt))
    out = pa.Table.from_batches(brown._count_words(0)(iter([pa.RecordBatch.from_pydict({"text": ["ab cd ab", "xyz", "ab"]})]))).to_pydict()
    assert len(set(out["key"])) == 2 and len(set(zip(out["key"], out["proof"]))) == 3 and sorted(out["n"]) == [1, 1, 3]


def test_brown_classes_are_bounded(spark):
    with pytest.raises(ValueError, match="127"):
        brown.train(spark.createDataFrame([("a",)], "text string"), classes=128)
