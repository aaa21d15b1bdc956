"""Operators on single texts, against their libraries or brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemloom.llm import byte_bpe, decontamination, neighbour_quality, personal_data, plane_files, toxicity, words
from itemloom.llm.shared import keep_shared, scratch_path
from tests.llm.conftest import FOLDER, mixed_texts, table

tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["  \x00 a\x1c b▁ 　 日本語 😀é\r\n\t x", "a" * 3000, "<|endoftext|> 12345  don't", "İ Σ ΑΣ. é́x ™ a™b", "THE, the. The", "x\x0by\x0cz"]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*enumerate(ODD), (90, None), (91, "")])


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.from_file(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def test_words_in_use_are_not_forgotten(monkeypatch):
    import public_tokenizers

    own = plane_files._Words(public_tokenizers.path("word_bpe_49k.json"))
    learn, learned = own.learn, []
    monkeypatch.setattr(plane_files, "REMEMBERED", 6)
    monkeypatch.setattr(own, "learn", lambda words: learned.append(len(words)) or learn(words))
    texts = ["Zuk zuk. 12 é a-b", "Zuk x zuk.", "zuk. y1 12\u00a0Zuk Zuk 日本 ÀÉ, q,", "Zuk ÀÉ,", "  Zuk new "]
    for t in texts:
        assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == own.ids(t).tolist()
    # The third text made the words too many, yet all of the fourth one are known.
    assert learned[2] == 5 and learned[3] == 0


def test_byte_bpe_equals_the_rank_library(spark, docs, odd, bpe):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(bpe.pieces)}, special_tokens={})
    texts = {100 + i: t for i, t in mixed_texts()} | dict(enumerate(ODD)) | {90: None, 91: ""}
    rows = bpe.encode(docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd), decoded=True).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: own.encode_ordinary(t or "") for i, t in texts.items()}
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in rows)
    again = bpe.decode(bpe.encode(odd)).collect()
    assert {r.doc_id: bytes(r.decoded) for r in again} == {r.doc_id: bytes(r.decoded) for r in rows if r.doc_id < 100}


def test_plane_files_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = {100 + i: t for i, t in mixed_texts()} | dict(enumerate(ODD)) | {90: None, 91: ""}
    folder = scratch_path(spark, "test")
    plane_files.write_ids(docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd), folder, path, end_id=1)
    start = 0
    for row in sorted(plane_files.read_ids(spark, folder).collect(), key=lambda r: r.key):
        ids = own.encode(texts[row.key] or "", add_special_tokens=False).ids + [1]
        assert (row.start, row.n_tokens, bytes(row.ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 9000])
def test_planes(n, bits):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    planes = plane_files.to_planes(ids, bits=bits)
    assert len(planes) == (32 if bits else 4)
    assert (plane_files.from_planes(planes, n) == ids).all()


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    hit, found = set(), set()
    for item, other in items:
        theirs = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), other or ""))
        size = min(10, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_extends_hits(spark, monkeypatch, most):
    """Also where item fingerprints are joined by shuffle."""
    monkeypatch.setattr(decontamination, "BROADCAST", most)
    texts = dict(mixed_texts())
    long = texts[30].split()
    items = [(1, " ".join(long[3:16])), (2, " ".join(long[20:30]).upper()), (3, "One TWO"), (4, None), (5, ""), (6, "日本"), (7, " ".join(long[:9])), (8, texts[39]), (9, "same " * 12)]
    rows = [*texts.items(), (200, "; ".join(long[2:17]) + " x"), (201, "one, two! one two"), (202, "a " + " ".join(long[20:29]))]
    found = decontamination.report(decontamination.find_hits(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()} == {i: brute_hits(t, items) for i, t in rows}


def test_decontamination_keeps_every_row(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    twice = docs.unionByName(docs).withColumns({c: F.lit(1) for c in ("key", "item", "words", "hash", "place")})
    assert decontamination.report(decontamination.find_hits(twice, items)).count() == 2 * docs.count()
    assert decontamination.report(decontamination.find_hits(docs, items.limit(0))).count() == docs.count()
    assert decontamination.report(decontamination.find_hits(empty, items)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    order = list(PATTERNS)
    found = sorted((m.start(), order.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group()))
    return [f"{order[k]}:{a}:{b}" for a, k, b in found]


PRIVATE = [
    "mail me: jo.e+x@mail.example.com, or a@b.c.@d.e", "😀 host 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 41111111111111111111",
    "call +1 (304) 555-3522. or +44.20.7946.0958x or +12", "no data", None, "", "@@a@b@c.d", "1.1.1.1" * 50, "9" * 5000, "a" * 30000 + "@", "x@y.z" * 300, "tel (555) 123-4567 mail bob (at) site (dot) org",
    "4111111111111111 " * 30, "00.000.0255.1 0001.2.3.4", "12 34  56 -78 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
]


def test_personal_data_base_spans(spark, docs):
    rows = [*enumerate(PRIVATE), *((100 + i, t) for i, t in mixed_texts())]
    found = {r.doc_id: r for r in personal_data.find(table(spark, rows)).select("doc_id", personal_data.written("base").alias("base"), personal_data.written("spans").alias("spans")).collect()}
    for i, t in rows:
        assert found[i].base == ",".join(base_spans(t)), t
        assert set(filter(None, found[i].base.split(","))) <= set(filter(None, found[i].spans.split(",")))


def test_expectation_maximisation_trusts_labelers_that_agree():
    patterns = [(0, (1, 1, 1), 60), (0, (-1, -1, -1), 60), (0, (1, 1, -1), 10), (0, (-1, -1, 1), 10)]
    right = personal_data.estimate(patterns)
    assert right[0, (1, 1, 1)] > 0.95 and right[0, (-1, -1, -1)] < 0.05
    assert right[0, (1, 1, -1)] > 0.5 > right[0, (-1, -1, 1)]
    assert personal_data.estimate([]) == {}


def test_personal_data_keeps_every_row(spark, docs, empty):
    assert personal_data.find(docs.unionByName(docs).withColumn("kind", F.lit(1))).count() == 2 * docs.count()
    assert personal_data.find(empty).count() == 0


def folds(spark, label):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return documents, labels.where(F.col(label).isNotNull())


@pytest.mark.parametrize("operator, label, threshold", [(neighbour_quality, "quality", 0.7), (toxicity, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, operator, label, threshold):
    documents, labels = folds(spark, label)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = operator.fit(documents, labels, usable=~held_out)
    scored = operator.score(documents, model).join(labels, "doc_id").where(held_out).collect()
    right = sum((r.score >= threshold) == bool(r[label]) for r in scored)
    assert len(scored) > 60 and right / len(scored) > 0.93
    assert all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize("operator, label", [(neighbour_quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels_or_texts(spark, docs, empty, operator, label):
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    model = operator.fit(docs, labels)
    assert len({r.score for r in operator.score(docs, model).collect()}) == 1
    one = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    model = operator.fit(docs.withColumns({"key": F.lit(1), "label": F.lit(2), "body": F.lit("")}), one)
    assert operator.score(docs, model).count() == docs.count()
    assert operator.score(empty, model).count() == 0


def test_interactions_are_learned():
    """Neither of two terms alone is toxic, only both together."""
    documents = [np.array(x) for x in ([0], [1], [0, 1], []) for _ in range(60)]
    labels = np.array([0.0, 0.0, 1.0, 0.0]).repeat(60)
    machine = toxicity.train(np.array([5, 9]), documents, labels, epochs=200)
    scores = machine.logits(np.array([0, 1, 0, 1]), np.array([1, 2, 4]))
    assert scores[0] < 0 > scores[1] and scores[2] > 0


def test_terms_that_matter_only_together(spark):
    """Each term is as frequent in both classes; only pairs tell them apart."""
    r = random.Random(5)
    pairs = {("red", "cat"): 1, ("blue", "dog"): 1, ("red", "dog"): 0, ("blue", "cat"): 0}
    rows, labels = [], []
    for i in range(400):
        pair = [*pairs][i % 4]
        rows.append((i, " ".join([*pair, *(f"w{r.randrange(300)}" for _ in range(20))])))
        labels.append((i, pairs[pair]))
    machine = toxicity.fit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(n, " ".join(pair)) for n, pair in enumerate(pairs)]
    scores = {x.doc_id: x.score for x in toxicity.score(table(spark, held), machine).collect()}
    assert [scores[n] > 0.5 for n in range(4)] == [True, True, False, False]


def test_rare_terms_of_a_small_sample(spark):
    """Four rows of sixty are enough for a word that no clean row has."""
    rows = [(i, " ".join(f"w{(7 * i + k) % 90}" for k in range(9)) + (" zuk" if i % 15 == 0 else "")) for i in range(60)]
    machine = toxicity.fit(table(spark, rows), spark.createDataFrame([(i, int(i % 15 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    scores = {x.doc_id: x.score for x in toxicity.score(table(spark, [(1, "zuk w3"), (2, "w3 w4")]), machine).collect()}
    assert toxicity.word_terms("zuk")[0] in machine.terms and toxicity.word_terms("w3")[0] not in machine.terms
    assert scores[1] > 1.3 * scores[2]


def test_rows_that_share_a_sign(spark):
    rows = [(s, k) for s in range(40) for k in range(s % 4)] + [(1000, k % 50) for k in range(500)]
    found = keep_shared(spark.createDataFrame(rows, "sign long, key long")).collect()
    counts = {s: len({k for x, k in rows if x == s}) for s, _ in rows}
    assert {tuple(r) for r in found} >= {(s, k) for s, k in rows if counts[s] > 1}
    alone = [r for r in found if counts[r.sign] == 1]
    assert len(alone) <= 8


def test_digests_of_the_queries(spark):
    from itemloom.llm import queries

    rows = {r.doc_id: r for r in queries.op2_byte_bpe(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    read = queries.op5_plane_files(spark, FOLDER).collect()
    assert len(read) == len(texts) and max(r.ids_crc32 for r in read) < 2**32 and zlib.crc32(b"") == 0


def test_rows_without_a_key(spark, bpe):
    rows = table(spark, [(None, "one two three four five"), (None, None), (1, "mail a@b.c")])
    items = spark.createDataFrame([(None, "three four five"), (4, None)], "item_id long, text string")
    assert bpe.encode(rows, decoded=True).count() == 3
    folder = scratch_path(spark, "test")
    plane_files.write_ids(rows, folder, tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert [r.start for r in plane_files.read_ids(spark, folder).orderBy("start").collect()][0] == 0
    assert sorted(r.n_hit for r in decontamination.report(decontamination.find_hits(rows, items)).collect()) == [0, 0, 3]
    assert personal_data.find(rows).count() == 3


def test_personal_data_adds_spans_of_looser_forms(spark):
    """One text per kind; what overlaps a base span is never added."""
    rows = [
        (1, "phone (304) 555-1234 or call 212-555-9876 now"), (2, "mail me: john (at) example (dot) com please"), (3, "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up"),
        (4, "x +1 (304) 555-1234 y a@b.com"), (5, "é😀 a@b.co 10.1.2.3"), (6, None), (7, ""),
    ]
    found = personal_data.find(table(spark, rows)).select("doc_id", personal_data.written("base").alias("base"), personal_data.written("spans").alias("spans")).collect()
    found = {r.doc_id: (r.base, r.spans) for r in found}
    assert found[1] == ("", "phone:6:20,phone:29:41") and found[2] == ("", "email:9:36") and found[3] == ("", "ip:5:44")
    assert found[4][0] == found[4][1] == "phone:2:19,email:22:29"
    assert found[5] == ("email:3:9,ip:10:18",) * 2 and found[6] == found[7] == ("", "")


def test_personal_data_in_a_text_of_many_spans(spark):
    text = " ".join(f"a{i}@b.com" for i in range(5000))
    found = personal_data.find(table(spark, [(1, text)])).select("base").first().base
    assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer(r"\S+", text)]


def test_scores_are_a_plain_vote_of_all_neighbours():
    """Cosines with every voter one by one, the nearest weighted by their squares."""
    r = np.random.default_rng(2)
    voters = neighbour_quality.Voters(r.normal(size=(20, 5)).astype(np.float32), neighbour_quality._unit(r.normal(size=(70, 5)).astype(np.float32)), r.integers(0, 2, 70).astype(float))
    terms = r.random((9, 20)).astype(np.float32)
    for row, score in zip(terms, voters.scores(terms), strict=True):
        own = row @ voters.space
        near = sorted(((float(own @ v) / float(np.linalg.norm(own)), y) for v, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)[: neighbour_quality.NEIGHBOURS]
        weights = [max(0.0, c) ** 2 for c, _ in near]
        want = (sum(w * y for w, (_, y) in zip(weights, near, strict=True)) + 0.01 * voters.labels.mean()) / (sum(weights) + 0.01)
        assert abs(score - want) < 1e-4


def test_logits_are_a_plain_sum_over_pairs():
    r = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(12), 0.3, r.normal(size=12), r.normal(size=(12, 4)))
    texts = [[], [4], [1, 5, 7], [0, 2, 3, 11]]
    found = machine.logits(np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts]))
    for t, logit in zip(texts, found, strict=True):
        pairs = sum(float(machine.vectors[a] @ machine.vectors[b]) for n, a in enumerate(t) for b in t[:n])
        assert abs(logit - (0.3 + sum(machine.weights[a] for a in t) + pairs)) < 1e-9


def test_pairs_of_terms_are_all_counted(spark):
    r = np.random.default_rng(4)
    texts = [np.unique(r.integers(0, 9, 4)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(2 in t and 5 in t) for t in texts])
    counts = lambda rows: (float(len(rows)), float(sum(labels[i] for i in rows)))
    strength = lambda rows: toxicity.evidence(*(np.array([x]) for x in counts(rows)), 200.0, labels.sum())[0]
    alone = np.array([strength([i for i, t in enumerate(texts) if a in t]) for a in range(9)])
    bound = 12.0
    want = [max([0.0, *(x for b in range(9) if (x := strength([i for i, t in enumerate(texts) if a in t and b in t]) - max(alone[a], alone[b])) > bound)]) for a in range(9)]
    pairs = toxicity.Pairs(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), labels, alone)
    assert np.allclose(toxicity.paired(spark, pairs, bound), want) and want[2] > 0 < want[5]


def test_words_of_a_block_of_texts():
    texts = ["", " a\tB\n\nc ", "one", "é日 x\r\n", "\n", "tail\nend"]
    batch = pa.RecordBatch.from_pydict({"body": texts})
    for most in (1, 1 << 20):
        parts = [w for _, w in words.blocks(iter([batch.slice(1), batch.slice(0, 1)]), most=most)]
        assert sum(len(w.texts) - 1 for w in parts) == len(texts)
    (_, own), = words.blocks(iter([batch]), lowered=True)
    split = [t.encode().split() for t in texts]
    assert np.diff(own.texts).tolist() == [len(x) for x in split]
    assert [bytes(own.data[i:j]) for i, j in zip(own.start, own.ends(), strict=True)] == [w for t in split for w in t]
    assert own.lines()[0].tolist() == np.cumsum([0, *(t.count("\n") + 1 for t in texts)]).tolist()
    names = {}
    for h, w in zip(own.hashes.tolist(), (w.lower() for t in split for w in t), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_the_driver_gets_features_only(spark, monkeypatch):
    """Terms that are frequent but tell nothing stay in the tasks."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["zuk"] * (i % 3 == 0) + [f"w{x}" for x in r.permutation(60)[:40]])) for i in range(300)]
    kind, values = type(table(spark, rows)), []
    take = kind.toArrow

    def taken(self):
        out = take(self)
        values.append(sum(len(c.combine_chunks().flatten()) for c in out.columns if pa.types.is_list(c.type)))
        return out

    monkeypatch.setattr(kind, "toArrow", taken)
    machine = toxicity.fit(table(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert toxicity.word_terms("zuk")[0] in machine.terms and max(values) <= len(rows) * len(machine.terms) < 300 * 10


def test_ascii_words_are_learned_as_bytes(monkeypatch):
    import public_tokenizers

    own = plane_files._Words(public_tokenizers.path("word_bpe_49k.json"))
    plain = plane_files.PLAIN
    monkeypatch.setattr(plane_files, "PLAIN", lambda t: plain(t) if not re.fullmatch("[A-Za-z]+[.,]?", t) else pytest.fail(t))
    texts = ["Zebra zebra, ZEBRA. a b. é. Éa, x.. . , .a a.b 1. a1, it's ™x", "", " \n", "zebra Zebra qwxz, qwxz. new é"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == [own.ids(t).tolist() for t in texts]
