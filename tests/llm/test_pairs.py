"""Operators on pairs of texts, against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from itemloom.llm import components, edit_embedding, line_dedup, part_enum, set_match, window_index
from tests.llm.conftest import mixed_texts, table

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def small(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def shingles(text, n):
    words = SPACES.findall(small(text))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components_of(sets, share):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size, share", [(4, 85), (5, 80), (2, 60)])
def test_part_enum_finds_all_components(spark, docs, size, share):
    found = {r.doc_id: (r.n_shingles, r.component) for r in part_enum.similar(docs, size=size, share=share).collect()}
    sets = {i: shingles(t, size) for i, t in mixed_texts()}
    want = components_of(sets, share)
    assert found == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("with_base", [True, False])
def test_part_enum_in_a_family_of_near_copies(spark, with_base):
    """Copies with few to many edits of their own, some edited alike, so that
    similarities lie on both sides of the bound."""
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, 70):
        own = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4, 5])):
            own[r.randrange(len(own))] = f"x{i}" if r.random() < 0.7 else f"y{r.randrange(3)}"
        if r.random() < 0.2:
            own[40:44] = ["all", "the", "same", "here"]
        rows.append((i, " ".join(own)))
    found = {x.doc_id: x.component for x in part_enum.similar(table(spark, rows), size=4, share=85).collect()}
    assert found == components_of({i: shingles(t, 4) for i, t in rows}, 85)
    assert 1 < len(set(found.values())) < 69


@pytest.mark.parametrize("cells", [1, 1 << 16, 1 << 22])
def test_only_differences_that_may_meet_get_rows(spark, cells):
    """A star of sets edited each in its own way, and groups of sets that share edits;
    one cell tells nothing of the differences, but no link may be lost."""
    r = random.Random(5)
    item = lambda: r.randrange(-(1 << 63), 1 << 63)
    base = [item() for _ in range(100)]
    sets = {0: base}
    for group in range(30):
        edited = base[group + 1 :] + [item() for _ in range(30)]
        for own in range(1 + 2 * (group % 5 == 0)):
            sets[len(sets)] = edited[own:] + [item() for _ in range(1 + own)]
    sets |= {len(sets) + i: [item() for _ in range(70)] + base[:30] for i in range(20)}
    rows = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "key long, items array<long>")
    stars = rows.select(F.lit(0).cast("long").alias("reference"), F.col("key").alias("node"), F.size("items").cast("long").alias("n"))
    compared = set_match.Stars(stars, rows, 80, 100, cells)
    named = spark.createDataFrame([(k, k) for k in sets], "node long, component long")
    found = {tuple(sorted(p)) for pairs in (compared.leads(), compared.others(named)) for p in pairs.collect()}
    plain = {k: set(v) for k, v in sets.items()}
    linked = [(a, b) for a, b in found if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    joined = {x.node: x.component for x in components.components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert len(joined) > 10 and {k: joined.get(k, k) for k in sets} == components_of(plain, 80)
    differences = compared.rows.agg(F.sum(F.size("theirs"))).first()[0]
    assert compared.items.count() < (differences if cells == 1 else differences / 4)


def test_part_enum_signatures_never_miss():
    """Sets of all sizes that differ as much as allowed share a signature."""
    r = random.Random(5)
    import numpy as np

    every = part_enum.bands(3000, 85, 100)
    for n in [1, 2, 5, 6, 7, 9, 12, 17, 25, 40, 44, 60, 100, 333, 800, 1500]:
        for _ in range(20):
            base = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
            lost = r.randint(0, n * 15 // 100)
            other = base[lost:]
            more = (100 * len(other) - 85 * n) // 85
            other = np.concatenate([other, np.array([r.getrandbits(64) for _ in range(r.randint(0, max(0, more)))], np.uint64)])
            common, union = n - lost, n + len(other) - (n - lost)
            if not len(other) or 100 * common < 85 * union:
                continue
            one, two = (set(part_enum.signatures(np.unique(x), [b for b in every if b.low <= len(x) <= b.high]).tolist()) for x in (base, other))
            assert one & two, (n, lost, len(other))


def test_part_enum_signs_the_best_filled_parts():
    """One signature more than two similar sets may differ in, where all parts
    with a shingle gave one before; for few differences, pairs of two parts more."""
    r = random.Random(4)
    import numpy as np

    for n in (9, 30, 100, 400):
        items = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        for band in part_enum.bands(1000, 80, 100):
            if band.low <= n <= band.high:
                most = math.comb(band.k + 2, 2) if 0 < band.k <= part_enum.FEW else band.k + 1
                assert 0 < len(part_enum.signatures(items, [band])) <= most


def test_line_dedup_of_rows_with_one_key(spark):
    """Equal rows are one document; other texts of the key are documents of their own."""
    line, other = "alpha beta gamma delta eta", "one two three four five"
    rows = [(1, f"{line}\n{other}"), (1, f"{line}\n{other}"), (1, line), (None, line), (2, f"{other}\n{line} "), (3, "x\n\nx y")]
    found = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(table(spark, rows)).collect())
    ones = [x for x in found if x[0] == 1]
    assert sum(x[3] for x in ones) in (1, 4)  # which text of key 1 comes first is settled by a hash
    assert len({x[1:] for x in ones}) == 2 and len(ones) == 3
    assert (2, "", 2, 2) in found and (0, line, 1, 0) in found and (3, "x\n\nx y", 2, 0) in found


@pytest.mark.parametrize("clash", ["n_lines", "key", "line", "gone", "row", "body", "twin"])
def test_line_dedup_with_columns_of_its_names(spark, clash):
    rows = table(spark, [(1, "a b c\na b c"), (2, "d")]).withColumn(clash, F.lit("mine"))
    found = {r.doc_id: r for r in line_dedup.deduplicate(rows).collect()}
    assert (found[1].text, found[1].n_removed, found[2].n_removed) == ("a b c", 1, 0)
    assert clash == "n_lines" or found[1][clash] == "mine"


@pytest.mark.parametrize("run, few, many, chunk", [(1024, 4, 64, 1 << 18), (2, 1, 64, 8), (64, 1, 1, 1 << 18)])
def test_line_dedup_keeps_first_lines(spark, docs, monkeypatch, run, few, many, chunk):
    """Also with runs cut in pieces, few neighbours and several words in a sign."""
    for name, value in (("RUN", run), ("LEAST", min(run, 64)), ("FEW", few), ("MANY", many), ("CHUNK", chunk), ("NEAR", min(run, 64))):
        monkeypatch.setattr(line_dedup, name, value)
    lines, first = {}, {}
    for i, t in mixed_texts():
        for j, line in enumerate((t or "").encode().lower().split(b"\n")):
            if words := frozenset(line.split()):
                lines.setdefault(words, []).append((i, j))
                first.setdefault(words, (i, j))
    stay = set()
    for words, at in first.items():
        before = (o for o in first if first[o] < at and 100 * len(o & words) >= 80 * len(o | words))
        if not any(True for _ in before):
            stay.add(at)
    found = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    for i, t in mixed_texts():
        all_lines = (t or "").split("\n")
        worded = [bool(x.encode().split()) for x in all_lines]
        kept = [x for j, (x, w) in enumerate(zip(all_lines, worded, strict=True)) if not w or (i, j) in stay]
        removed = len(all_lines) - len(kept)
        assert (found[i].n_lines, found[i].n_removed) == (sum(worded), removed)
        assert found[i].text == (t if not removed else "\n".join(kept))


def test_line_dedup_signs_the_documents_once(spark, monkeypatch):
    """Lines with over 64 candidates, none of which matches: words are replaced by
    others that flip the same bits. The last line matches a late one of them."""
    import numpy as np

    from itemloom.llm.words import Words

    made = [f"w{i}" for i in range(60000)]
    text = " ".join(made).encode()
    hashes = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), True).hashes
    alike = [[made[i] for i in np.flatnonzero((hashes & np.uint64(255)) == b)] for b in range(5)]
    base = [f"b{i}" for i in range(35)]
    lines = [base + [x[i] for x in alike] for i in range(90)]
    lines.append([f"c{i}" if i < 2 else w for i, w in enumerate(lines[80])])
    calls, signed = [], line_dedup._signed
    monkeypatch.setattr(line_dedup, "_signed", lambda *a: calls.append(a) or signed(*a))
    found = line_dedup.deduplicate(table(spark, [(i, " ".join(x)) for i, x in enumerate(lines)]))
    assert {r.doc_id for r in found.where("n_removed > 0").collect()} == {90}
    assert len(calls) == 1


def test_line_dedup_notes_a_pair_once(spark, monkeypatch):
    """A line and its near copy share many of their first words, in a row; lines of
    words that no other line has aren't handed on."""
    line = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(line)), (2, " ".join([*line[:50], "other", *line[51:]])), (3, " ".join(f"x{i}" for i in range(40)))]
    noted, moved, settle, signed = [], [], line_dedup.settle, line_dedup._signed

    def settled(df, name):
        out = settle(df, name)
        noted.extend(out.where(F.col("kind").isin(line_dedup.PAIR, line_dedup.FURTHER)).collect() if name == "pairs" else ())
        return out

    def counted(*a):
        out = signed(*a)
        moved.extend(r.key for r in out.select("key").collect())
        return out

    monkeypatch.setattr(line_dedup, "settle", settled)
    monkeypatch.setattr(line_dedup, "_signed", counted)
    found = {r.doc_id: r.n_removed for r in line_dedup.deduplicate(table(spark, rows)).collect()}
    assert found == {1: 0, 2: 1, 3: 0}
    assert 1 <= len(noted) <= 2
    assert 3 not in {k for x in moved for k in ([x] if isinstance(x, int) else memoryview(x).cast("q"))}


def test_line_dedup_packs_rows_and_puts_them_in_order():
    import numpy as np

    r = np.random.default_rng(3)
    draw = lambda n: r.integers(-(1 << 63), (1 << 63) - 1, n)
    for rows, most in ((1, 60), (500, 60), (500, 300), (500, 9000)):
        held = [
            {"sign": r.choice(draw(40), rows), "before": draw(rows).view(np.uint64), "class": r.choice(draw(30), rows), "key": draw(rows), "line": np.arange(rows), "n": r.integers(1, most, rows),
             "place": np.zeros(rows, np.int64), "hot": r.random(rows) < 0.5, "parity": draw(4 * rows).view(np.uint64).reshape(rows, 4), "dealt": draw(rows).view(np.uint64)}
            for _ in range(2)
        ]
        for x in held:
            x["parity"][x["n"] <= line_dedup.LONG, 1:] = 0
        batch = line_dedup._packed(held, 16)
        found = line_dedup._unpacked(batch)
        assert batch.num_rows == len(set(found["part"].tolist())) <= 16
        names = ["sign", "before", "class", "key", "line", "n", "place", "hot"]
        told = lambda x, parity: sorted(zip(*(x[c].tolist() for c in names), *(p.tolist() for p in parity), strict=True))
        whole = {c: np.concatenate([x[c] for x in held]) for c in (*names, "parity")}
        assert told(found, [found[c] for c in line_dedup.PARITIES]) == told(whole, whole["parity"].T)
        # Also with classes that agree in the half that is compared first.
        for name in (whole["class"], whole["class"] >> 40 << 40 | r.integers(0, 9, 2 * rows)):
            at = line_dedup._in_order(whole["sign"], whole["n"], name, whole["key"], whole["line"])
            assert sorted(at.tolist()) == list(range(2 * rows))
            group = list(zip(whole["sign"][at].tolist(), whole["n"][at].tolist(), strict=True))
            assert group == sorted(group)
            inner = {}
            for i in at.tolist():
                inner.setdefault((whole["sign"][i], whole["n"][i], name[i]), []).append((whole["key"][i], whole["line"][i]))
            assert all(x == sorted(x) for x in inner.values())
            runs = [(whole["sign"][i], whole["n"][i], name[i]) for i in at.tolist()]
            assert 1 + sum(x != y for x, y in zip(runs, runs[1:], strict=False)) == len(inner)


def brute_windows(texts):
    seen, out = set(), {}
    for i, t in texts:
        words = SPACES.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_window_index_removes_later_windows(spark, docs, batches):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in window_index.deduplicate(docs, batches=batches).collect()}
    assert found == brute_windows(mixed_texts())


def test_window_index_compacts(spark, docs):
    index = window_index.WindowIndex(spark)
    want = brute_windows(mixed_texts())
    for low in range(0, 50, 8):
        part = docs.where(F.col("doc_id").between(low, low + 7))
        assert {r.key: (r.n_words, r.n_removed, r.kept) for r in index.add(part).collect()} == {i: want[i] for i in want if low <= i < low + 8}
        assert len(index.runs) < window_index.FANOUT


@pytest.mark.parametrize("batches", [1, 3])
def test_window_index_keeps_a_copy_of_what_repeated_rows_share(spark, docs, batches):
    twice = docs.unionByName(docs)
    want = brute_windows(mixed_texts())
    found = window_index.deduplicate(twice, batches=batches).collect()
    assert len(found) == 2 * len(want) and {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found} == {(i, *want[i]) for i in want}
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(5, f"a b {passage}"), (5, f"a b {passage}"), (5, " ".join(f"q{i}" for i in range(90)) + " " + passage), (9, f"{passage} c d e"), (9, f"{passage} c d e"), (9, f"{' x' * 30} {passage} f")]
    found = {(r.doc_id, r.n_removed, r.kept) for r in window_index.deduplicate(table(spark, rows), batches=batches).collect()}
    assert {x for x in found if x[0] == 5} == {(5, 0, t) for _, t in rows[:3]}
    assert (9, 20, "c d e") in found and any(k == 9 and "p0" not in kept and kept.endswith("f") for k, _, kept in found)


def test_edit_embedding(spark, docs):
    found = {r.doc_id: r for r in edit_embedding.compare_edits(docs).collect()}
    texts = [t or "" for _, t in sorted(mixed_texts(), reverse=True)]
    for j, (i, _) in enumerate(sorted(mixed_texts(), reverse=True)):
        mine, following = texts[j], texts[(j + 1) % len(texts)]
        half = len(mine) // 2
        other = mine[: len(mine) - half] + following[:half]
        one, two, three = map(edit_embedding.of_text, (mine, other, following))
        row = found[i]
        assert (row.n_chars, row.fingerprint, row.edited_fingerprint) == (len(mine), one, two)
        assert row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (row.near_edited, row.near_next) == (edit_embedding.likeness(one, two), edit_embedding.likeness(one, three))


def test_edit_embedding_of_one_document(spark):
    row = edit_embedding.compare_edits(table(spark, [(5, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0


def test_few_edits_stay_near():
    r = random.Random(2)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    text = make(2000)
    edited = list(text)
    for _ in range(6):
        at = r.randrange(len(edited))
        edited[at : at + 1] = r.choice([[], ["q", "z"], ["x"]])
    near = edit_embedding.likeness(edit_embedding.of_text(text), edit_embedding.of_text("".join(edited)))
    assert near > 0.5 > 0.25 > edit_embedding.likeness(edit_embedding.of_text(text), edit_embedding.of_text(make(2000)))
    assert edit_embedding.likeness(edit_embedding.of_text(""), edit_embedding.of_text("")) == 1.0
    assert edit_embedding.likeness(edit_embedding.of_text(""), edit_embedding.of_text(text)) < 0.1


def test_near_documents(spark):
    r = random.Random(3)
    make = lambda n: "".join(r.choice("abcdefghij   ") for _ in range(n))
    a, b = make(900), make(900)
    rows = [(1, a), (2, a), (3, a[:-3] + "xyz"), (4, b), (5, make(900)), (6, None), (7, "")]
    found = {r.doc_id: r.component for r in edit_embedding.near_documents(edit_embedding.fingerprints(table(spark, rows))).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}


def test_near_documents_of_other_lengths(spark):
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefghij   ") for _ in range(n))
    texts = []
    for n in (1024, 1024, 1360, 700, 2050, 5000):
        base = make(n)
        texts += [base, base + "x", base[:-2], base + make(n // 30), base[: -n // 12], base[: n - 40] + make(4) + base[n - 40 :], base[: n - 60] + base[n - 53 :], base + make(n // 7), base + make(n)]
    prints = [edit_embedding.of_text(t) for t in texts]
    like = [(i, j) for i in range(len(texts)) for j in range(i) if edit_embedding.likeness(prints[i], prints[j]) >= 0.8]
    assert sum(prints[i][:8] != prints[j][:8] for i, j in like) > 40
    signs = [{*edit_embedding.band_signs(p, 0.8)} for p in prints]
    assert sum(bool(signs[i] & signs[j]) for i, j in like) >= 0.98 * len(like)
    first = [*range(len(texts))]
    for _ in first:
        for i, j in like:
            first[i] = first[j] = min(first[i], first[j])
    rows = table(spark, [*enumerate(texts)])
    found = {x.doc_id: x.component for x in edit_embedding.near_documents(edit_embedding.fingerprints(rows)).collect()}
    assert found == dict(enumerate(first))


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_connect_compares_what_the_first_rounds_leave(spark):
    """Groups whose nodes are linked in a ring, but not to the first ones."""
    rows = [(1, n, 1) for n in range(12)]
    linked = {(a, a + 4) for a in range(4, 8)}
    verify = lambda pairs: pairs.where(F.struct("a", "b").isin([F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in linked]))
    found = components.connect(spark.createDataFrame(rows, "sign long, node long, n int"), verify, lambda a, b: F.lit(True))
    assert {r.node: r.component for r in found.collect()} == {x: min(p) for p in linked for x in p}


def test_empty_tables(empty):
    assert part_enum.similar(empty).collect() == []
    assert line_dedup.deduplicate(empty).collect() == []
    assert window_index.deduplicate(empty).collect() == []
    assert edit_embedding.compare_edits(empty).collect() == []


def test_repeated_rows_stay_and_other_columns_do_no_harm(spark, docs):
    twice = docs.unionByName(docs).withColumns({c: F.lit(1) for c in ("key", "n", "sign", "line", "body", "component", "age", "place")})
    n = 2 * docs.count()
    assert part_enum.similar(twice).count() == n
    assert line_dedup.deduplicate(twice).count() == n
    assert window_index.deduplicate(twice).count() == n
    assert edit_embedding.compare_edits(twice).count() == n
    once = {r.doc_id: r.component for r in part_enum.similar(docs).collect()}
    assert {r.doc_id: r.component for r in part_enum.similar(twice).collect()} == once


def test_least_common_is_exact():
    for n in range(1, 300):
        assert line_dedup.least_common(n, 80, 100) == math.ceil(n * 4 / 5 - 1e-12)


def test_rows_without_a_key(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = table(spark, [(1, text), (None, text), (None, "other words here"), (2, None)])
    assert {(r.doc_id, r.component) for r in part_enum.similar(rows).collect()} == {(1, 1), (None, 1), (None, None), (2, 2)}
    assert sorted(r.n_removed for r in line_dedup.deduplicate(rows).collect()) == [0, 0, 0, 0]
    assert sorted(r.n_removed for r in window_index.deduplicate(rows).collect()) == [0, 0, 0, 0]
    assert edit_embedding.compare_edits(rows).count() == 4
    assert edit_embedding.near_documents(edit_embedding.fingerprints(rows)).count() == 4


def test_texts_are_walked_together(monkeypatch):
    """As each alone, also when few are left; no text but the longest goes character by character."""
    r = random.Random(6)
    classes = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 7, 900, 5000, 3, 0, 250, *range(40, 60))]
    ticks = [r.randrange(9000) for _ in classes]
    alone = [edit_embedding.walk(c, t).tolist() for c, t in zip(classes, ticks)]
    assert [x.tolist() for x in edit_embedding.walks(classes, ticks)] == alone and edit_embedding.walks([], []) == []
    monkeypatch.setattr(edit_embedding, "ALONE", 2)
    walk, walked = edit_embedding.walk, []
    monkeypatch.setattr(edit_embedding, "walk", lambda c, t=0: walked.append(len(c)) or walk(c, t))
    assert [x.tolist() for x in edit_embedding.walks(classes, ticks)] == alone
    assert sorted(walked) == [900 - 250, 5000 - 250]
