"""The text operators against brute force, on small fixtures with nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadwake.llm import jaccard_join, ledger, metric_join, mixing, ordinal, pieces, pii, suffix_dedup, toxicity, warc
from leadwake.session import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, spans string, size long, key string"


def docs_of(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), 7, "r", "x", 1, "k") for i, t, s in rows], CLASH).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (4, "one two", "b"), (None, "x y z", "b"), (5, "word " * 30_000, None),
         (6, "a b c d e f g h", "é"), (7, "A B C D E F G H", "é"), (8, "\x00\x01 ▁ \x0b漢字🙂", "b")]


# ---- 1 ---------------------------------------------------------------------------------------
def test_pieces_equal_the_library():
    import sentencepiece
    model = pieces.default_model()
    own, lib = pieces.PieceCoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng, signs = random.Random(1), "abcdeth ing \n\n▁éç.,|0123456789漢"
    texts = ["", " ", "  a ", "\n\n", "▁x ▁▁ y", "a" * 3000, " " * 300, "\x01 \x00", "🙂 zz", "\r\n\x0b", "  x"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["".join(own.text[rng.randrange(259, own.size)].replace("▁", rng.choice([" ", "▁", ""])) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    for t in texts:
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert array("I", own.encode(t)).tolist() == want, t[:60]
        assert own.decode(own.encode(t)) == lib.decode(want), t[:60]
    for _ in range(500):
        ids = [rng.randrange(own.size) if rng.random() < .5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 10))]
        assert own.decode(array("I", ids).tobytes()) == lib.decode(ids), ids


def test_pieces_on_rows(spark, given):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.default_model())
    rows = EDGES + [(i, t, "a") for i, t in given]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(pieces.encode(docs_of(spark, rows), pieces.default_model(), decode=True)).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pieces.encode(docs_of(spark, []), pieces.default_model()).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------
def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(400):
        g = int(rng.integers(0, 3))
        words = ["bad", "fair", "good"][g:g + 1] * int(rng.integers(1, 4)) + [f"w{rng.integers(0, 40)}" for _ in range(12)]
        rows.append(ordinal._vector(" ".join(words)))
        grades.append(g)
    weights, cut = ordinal.fit(rows, np.array(grades), 3)
    assert cut[0] < cut[1]
    s = np.array([sum(weights[k] * v for k, v in zip(*r)) for r in rows])
    assert (np.searchsorted(cut, s) == grades).mean() > 0.95


def test_ordinal_rejects_rated_junk(spark):
    rng = random.Random(5)
    good = [(k, " ".join(rng.choice(["river", "stone", "cloud", "field", "house", "light"]) for _ in range(60)), "a") for k in range(100)]
    bad = [(k, " ".join(f"{w} | {w} |" for w in rng.sample("abcdefghij", 6)) * 3, "a") for k in range(100, 200)]
    labels = spark.createDataFrame([(k, int(k < 100), 0) for k in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    got = ordinal.classify(docs_of(spark, good + bad + EDGES), ordinal.graded(labels))
    kept = {r.doc_id: r.kept for r in got.select("row.doc_id", "kept").collect() if r.doc_id and r.doc_id > 10}
    assert all(kept[k] == (k < 100) for k in range(11, 200))
    assert got.count() == 200 + len(EDGES) and got.select("row.*").columns == docs_of(spark, EDGES).columns
    nothing = ordinal.classify(docs_of(spark, EDGES), ordinal.graded(labels.limit(0)))
    assert nothing.filter("kept").count() == len(EDGES)
    assert ordinal.classify(docs_of(spark, []), ordinal.graded(labels)).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------
def test_mixing_targets_and_reruns(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)]
    df = docs_of(spark, rows + EDGES)
    first = sorted(((r.id, r.size, r.source_size, r.target, r.copies) for r in mixing.mix(df).collect()), key=repr)
    again = sorted(((r.id, r.size, r.source_size, r.target, r.copies) for r in mixing.mix(df.repartition(5)).collect()), key=repr)
    assert first == again and len(first) == len(rows) + len(EDGES)
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows + EDGES)
    by = defaultdict(lambda: [0, 0, 0, 0])
    for r in mixing.mix(df).collect():
        b = by[r.source]
        assert r.size == len(WORD.findall(r.row.text or "")) and 0 <= r.copies <= 3
        b[0] += r.size * r.copies
        b[1], b[2] = r.target, r.source_size
        b[3] = max(b[3], r.size)
    assert abs(sum(b[1] for b in by.values()) - total) < 1e-6 * total
    assert all(abs(b[0] - b[1]) <= b[3] / 2 + 1e-6 for b in by.values()) and all(b[1] <= 3 * b[2] + 1e-6 for b in by.values())
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free = [by[s][1] / weight[s] for s in order if by[s][1] < 3 * by[s][2] - 1e-6]
    assert max(free) - min(free) < 1e-6 * max(free) and all(by[s][1] / weight[s] <= max(free) + 1e-6 for s in order)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r[4] for r in first)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r.copies for r in mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_mixing_splits_equal_rows(spark):
    """500 equal rows without an id are no block: as many are taken as fit, and reruns take as many."""
    same = " ".join(["equal"] * 25)
    rows = [(None, same, "a")] * 500 + [(k, " ".join(["word"] * 10), "a") for k in range(100)] + [(1000 + k, "some more words here", "b") for k in range(900)]
    rows += [(7, "three times one", "c")] * 30 + [(None, "", "c")] * 4
    counts = []
    for parts in (1, 6):
        found = mixing.mix(docs_of(spark, rows).repartition(parts)).collect()
        assert len(found) == len(rows)
        for source in "abc":
            mine = [r for r in found if r.source == source]
            assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 or mine[0].target == 3 * mine[0].source_size
            assert max(r.copies for r in mine) <= 3 and max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
        counts.append(sorted((repr(r.id), r.source, r.size, r.copies) for r in found))
    assert counts[0] == counts[1]
    split = {r.copies for r in found if r.source == "a" and r.id is None}
    assert len(split) == 2, "the cut lies among the equal rows"



# ---- 4 ---------------------------------------------------------------------------------------
def test_ledger_against_plain_python(spark, given):
    rows = EDGES + [(i, t, "a") for i, t in given] + [(90 + k, "to be or not to be to be or\nx\nx\n\n \nx", "a") for k in range(2)]
    got = Counter(tuple(r) for r in ledger.ledger(docs_of(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        runs = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if runs[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want
    assert ledger.ledger(docs_of(spark, [])).count() == 0


def test_ledger_ablation(spark, given):
    book = ledger.ledger(docs_of(spark, [(i, t, "a") for i, t in given])).cache()
    bits = [r.failure_bits for r in book.collect()]
    got = {(r.policy, r.dropped): r.n_kept for r in ledger.ablation(book).collect()}
    for name, rules in ledger.POLICIES.items():
        for drop in (None, *rules):
            assert got[(name, drop)] == sum(b & ledger.mask(r for r in rules if r != drop) == 0 for b in bits)


# ---- 5 ---------------------------------------------------------------------------------------
def plain_words(text):
    return set(re.findall(r"\w+|[^\w\s]", (text or "").lower()))


def plain_grams(word):
    led = " " * (toxicity.ORDER - 1) + word + " "
    return [led[k:k + toxicity.ORDER] for k in range(len(word) + 1)]


def plain_model(counts):
    """P(last character | those before) of the shared model and of both classes for every gram, by the formula, gram by gram."""
    def smooth(table, gram, discount, lower):
        row = [n for g, n in table.items() if g[:-1] == gram[:-1] and n > 0]
        if not row:
            return lower
        return max(table[gram] - discount, 0) / sum(row) + sum(min(n, discount) for n in row) / sum(row) * lower

    levels = [{g: sum(n) for g, n in counts.items()}]
    while len(next(iter(levels[-1]))) > 1:
        before = defaultdict(set)
        for g in levels[-1]:
            before[g[1:]].add(g[0])
        levels.append({g: len(b) for g, b in before.items()})

    def shared(level, gram):
        if len(gram) == 1:
            return levels[level][gram] / sum(levels[level].values())
        return smooth(levels[level], gram, toxicity.DISCOUNT, shared(level + 1, gram[1:]))

    out = {}
    for g in counts:
        p = shared(0, g)
        out[g] = (p, *(smooth({x: n[c] for x, n in counts.items()}, g, toxicity.CLASS_DISCOUNT, p) for c in (1, 2)))
    return out


def plain_counts(rows):
    """rows: (text, class)."""
    counts = defaultdict(lambda: [0, 0, 0])
    for text, kind in rows:
        for w in plain_words(text):
            for g in plain_grams(w):
                counts[g][kind] += 1
    return dict(counts)


def test_kneser_ney_sums_to_one():
    rng = random.Random(2)
    rows = [(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(6)), rng.randrange(3)) for _ in range(40)]
    p = plain_model(plain_counts(rows))
    for k in range(3):
        total = defaultdict(float)
        for g, x in p.items():
            total[g[:-1]] += x[k]
        assert max(total.values()) <= 1 + 1e-9  # what is missing goes to characters that don't follow this history anywhere


def test_spelled_numbers_windows_exactly():
    for words in ([], ["ab", "é", "漢字漢字"], [chr(0x4e00 + k) * 2 + chr(0x4e00 + k + 1) for k in range(9000)]):
        grams, sizes, number = toxicity.spelled(words)
        assert sizes.tolist() == [len(w) + 1 for w in words] and len(set(grams)) == len(grams)
        assert [grams[k] for k in number] == [g for w in words for g in plain_grams(w)]


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    words = ["morning", "garden", "letter", "window", "travel", "music", "paper", "winter"]
    rows = []
    for k in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if k % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["skragg", "vlumpt"]) + rng.choice(["", "en", "er"])
        rows.append((k, " ".join(w), "a"))
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(600)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(spark, rows + [(1000, None, "a"), (1001, "", "a"), (None, "x", "a")]), labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert toxicity.toxicity(docs_of(spark, []), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs_of(spark, EDGES), labels.limit(0)).collect()} == {0.0}


def test_toxicity_counts_grow_and_tell_scripts_apart(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x430, 0x44f)]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(150)]
    bad = [words.pop(), words.pop()]
    # Each expression has a twin whose characters are the same modulo 3: one symbol for each could not part them.
    twins = ["".join(chr(ord(c) + (3 if ord(c) < 0x43f else -3)) for c in w) for w in bad]
    rows = []
    for k in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(10, 40))]
        w[rng.randrange(len(w))] = rng.choice(bad if k % 6 == 0 else twins)
        rows.append((k, " ".join(w), "a"))
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(docs_of(spark, rows), labels).collect() if r.held_out]
    assert len(got) > 80 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in got]) > 0.97


def test_gram_counts_by_force(spark):
    texts = ["", "漢字漢字 Ab", "abcdef ab, ab!", "Привет мир"] * 5 + [None, "x" * 400]
    want = plain_counts((t, k % 3) for k, t in enumerate(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = materialize(toxicity.map_arrow(docs, lambda batches: toxicity._index(batches, 300), toxicity.INDEX))
    known = index.select("chunk", F.posexplode("doc_ids").alias("pos", "doc_id")).filter("doc_id % 3 > 0").groupBy("chunk").agg(
        F.collect_list(F.struct("pos", F.expr("cast(doc_id % 3 as int)").alias("class"))).alias("known"))
    got = {r.gram: [r.n_none, r.n_ordinary, r.n_toxic] for r in toxicity.gram_counts(index.join(known, "chunk", "left")).collect()}
    assert got == want and index.count() > 3


def test_toxicity_score_by_force(spark):
    rng = random.Random(11)
    words = ["abend", "abel", "bad", "dabei", "ede", "gabe", "Ähre", "9", "ab-bau"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) + (" " + rng.choice(["vlump", "vlumps"]) if k % 3 == 0 else "") for k in range(200)]
    texts += ["", None, texts[3], "unseen here", "漢字"]
    toxic = {k: int(k % 3 == 0) for k in range(160)}
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int")
    ids = {r.doc_id: (r.h, r.c) for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.for_curve(F.col("doc_id")).alias("c")).collect()}
    kind = [1 + toxic[k] if k in toxic and not any(ids[k]) else 0 for k in range(len(texts))]
    ratio = {g: np.log(t) - np.log(o) for g, (_, o, t) in plain_model(plain_counts(zip(texts, kind))).items()}
    x = []
    for t in texts:
        of = [(sum(ratio[g] for g in plain_grams(w)), len(w) + 1) for w in plain_words(t)]
        high = sorted((a / n for a, n in of), reverse=True)[:toxicity.PEAK]
        x.append((sum(a for a, _ in of) / max(sum(n for _, n in of), 1), sum(high) / max(len(high), 1)))
    x = np.array(x)
    fold = [k for k in toxic if not ids[k][0] and ids[k][1]]
    centre, scale = x[fold].mean(axis=0), x[fold].std(axis=0) + 1e-9
    x = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    want = 1 / (1 + np.exp(-np.clip(x @ toxicity._logistic(x[fold], np.array([float(toxic[k]) for k in fold])), -30, 30)))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(fold) > 8 and np.allclose([got[k] for k in range(len(texts))], want, atol=1e-6)
    assert want.std() > 0.1


# ---- 6 ---------------------------------------------------------------------------------------
def test_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(120):
        n, width = rng.randint(1, 40), rng.choice([10, 68, 100])
        base = [bytes(rng.choice(b"ab\0") for _ in range(width)) for _ in range(4)]
        rows = []
        for _ in range(n):
            b = bytearray(rng.choice(base))
            if rng.random() < .7:
                b[rng.randrange(width)] = rng.choice(b"abc\0")
            rows.append(bytes(b))
        segment = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        order, shared = suffix_dedup.deep_shallow(np.frombuffer(b"".join(rows), np.uint8).reshape(n, width), segment)
        assert [(segment[k], rows[k]) for k in order] == sorted(zip(segment, rows))
        for k in range(n):
            if k == 0 or segment[k] != segment[k - 1]:
                assert shared[k] == -1
            else:
                a, b = rows[order[k]], rows[order[k - 1]]
                assert shared[k] == next((i for i in range(width) if a[i] != b[i]), width)


def repeats_by_force(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        covered = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                covered[s] += 1
                covered[s + 100] -= 1
            else:
                seen.add(raw[s:s + 100])
        gone = np.cumsum(covered[:-1]) > 0
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(1)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(250):
        t = ""
        for _ in range(rng.randint(0, 4)):
            k, p, a = rng.random(), rng.choice(passages), rng.randrange(300)
            t += (p[a:a + rng.randint(60, 300)] if k < .5 else "".join(rng.choice("xyz é") for _ in range(rng.randint(1, 150))) if k < .8
                  else rng.choice("ab") * rng.randint(50, 400) if k < .9 else "abc" * rng.randint(30, 90))
        rows.append((i, t))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == repeats_by_force(rows)


def test_repeats_edges(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = EDGES + [(20, long, "a"), (20, long, "a"), (21, long, "a"), (None, long, "a")]
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    assert got[20] == [(300, 0), (300, 0)] and got[21] == [(300, 300)] and (300, 300) in got[None] and got[1] == [(0, 0)]
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("crowded", [0, 20_000])
def test_repeated_row_keeps_its_first_bytes(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(3)
    rows = []
    for i in range(0, 60, 2):
        long = "".join(rng.choice("abcdefgh ") for _ in range(400))
        rows += [(i, long), (i, long), (i + 1, long[:200] + "#" + long[201:])]
    got = defaultdict(set)
    for r in suffix_dedup.remove_repeats(docs_of(spark, [(i, t, "a") for i, t in rows])).collect():
        got[r.doc_id].add((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert got == {i: {x} for i, x in repeats_by_force(list(dict(rows).items())).items()}


# ---- 7 ---------------------------------------------------------------------------------------
def page_rows(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "s", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, sha1 string, first int").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * k + "</p>" for k in range(40)]
    rows = [(k, f"http://a/{k} \n", html[k % 30]) for k in range(60)] + [(70, None, None), (71, "", ""), (72, "u", None), (None, "v", html[0]), (3, "again", html[3]), (80, "é", "é漢" * 5000)]
    names = warc.write(page_rows(spark, rows), str(tmp_path))
    got = warc.read(spark, str(tmp_path), names).collect()
    assert len(got) == len(rows) and not [r.error for r in got if r.error]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == warc.base32(hashlib.sha1(h.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first[h] else ("revisit", first[h]))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == h.encode()
    assert warc.write(page_rows(spark, []), str(tmp_path / "none")).count() == 0


def test_warc_archive_has_a_dictionary_and_finds_damage():
    records = [warc.record(k, f"u{k}", f"<html>{'word ' * k}</html>".encode(), warc.base32(hashlib.sha1(f"<html>{'word ' * k}</html>".encode()).hexdigest()), None) for k in range(200)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(data)) == records and [warc.parse(r)["page_id"] for r in records] == list(range(200))
    assert any(isinstance(f, ValueError) for f in warc.frames(data[:-3]))
    broken = bytearray(data)
    broken[-20] ^= 255
    assert any(isinstance(f, ValueError) for f in warc.frames(bytes(broken))) or list(warc.frames(bytes(broken))) != records
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"Content-Length: ", b"Content-Length: 9"), (b"<html>", b"<HTML>")):
        with pytest.raises(ValueError):
            warc.parse(records[50].replace(old, new))


# ---- 8 ---------------------------------------------------------------------------------------
def link_by_force(rows):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i, s in sets)


def test_jaccard_components_against_all_pairs(spark):
    rng = random.Random(6)
    rows, words = [], [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120, 200]))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(30)]
    for k in range(300):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w + (passage if k % 3 == 0 else [])).upper() if k % 7 == 0 else " ".join(w + (passage if k % 3 == 0 else []))))
    rows += [(400, None), (401, ""), (402, "one two"), (403, "ONE  two"), (5, rows[9][1]), (404, "x " * 20_000)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, [(i, t, "a") for i, t in rows] + [(None, "one two", "a")])).collect() if r.doc_id is not None)
    assert got == link_by_force(rows)
    assert jaccard_join.join(docs_of(spark, [])).count() == 0


# ---- 9 ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("cell", [4096, 150])
def test_range_join_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(k, [float(x) for x in (centres[k % 14] + rng.normal(size=8) * .25 if k % 14 < 12 else rng.normal(size=8))]) for k in range(900)]
    rows += [(4000 + k, rows[5][1]) for k in range(30)] + [(4100, [2 * x for x in rows[5][1]])]
    odd = [(3000, [0.0] * 8), (3001, None), (3002, [1.0, None] + [0.0] * 6), (3003, [float("nan")] * 8), (3004, [1.0] * 3), (3005, []), (3006, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + odd], "vec_id long, embedding array<double>, label int, v string, w int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.join(df).collect()}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= .9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))
        if (low == label).all():
            break
        label = low
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label)} | {i: (0, i, True) for i, _ in odd}
    assert got == want
    assert metric_join.join(df.limit(0)).count() == 0


# ---- 10 --------------------------------------------------------------------------------------
def spans_by_force(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_patterns(given):
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice("ab@.@.0123456789 -+()%é\n..") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == spans_by_force(t), t
    for _, t in given:
        assert pii.base_spans(t) == spans_by_force(t)
    assert pii.base_spans("9" * 50_000 + "." + "a" * 50_000 + "@") == []


def test_semi_markov_sums_and_best_path():
    """Partition, posteriors and best path against every segmentation of a small lattice."""
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 6)
        cands = [(i, j, "phone") for i in range(n) for j in range(i + 1, n + 1) if rng.random() < .6]
        scores = [rng.uniform(-2, 2) for _ in cands]
        paths = []

        def walk(at, used):
            if at == n:
                paths.append(used)
                return
            walk(at + 1, used)
            for k, c in enumerate(cands):
                if c[0] == at:
                    walk(c[1], used + [k])
        walk(0, [])
        weight = [np.exp(sum(scores[k] for k in p)) for p in paths]
        z, post = pii._lattice(n, cands, scores)
        assert np.isclose(z, np.log(sum(weight)))
        for k in range(len(cands)):
            assert np.isclose(post[k], sum(w for w, p in zip(weight, paths) if k in p) / sum(weight))
        assert np.isclose(sum(scores[k] for k in pii._best(n, cands, scores)), np.log(max(weight)))


def test_field_adds_rewritten_spans_and_keeps_base_ones(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(12)) + f" {word()}{rng.randint(1, 99)}@{word()}.com " + " ".join(word() for _ in range(12)) for _ in range(150)]
    rows = [(600 + k, t, "a") for k, t in enumerate(texts)] + [(500, f"{'word ' * 20}anna12 (at) mailer dot com {'word ' * 20}", "a"), (501, "plain words only " * 20, "a")] + EDGES
    got = {r.row.doc_id: r for r in pii.find(docs_of(spark, rows)).collect()}
    for k, t, _ in rows:
        if k is not None and k != 4:
            assert [(s.kind, s.start, s.stop) for s in got[k].spans if s.base] == spans_by_force(t or "")
    assert any(not s.base and s.kind == "email" for s in got[500].spans) and not got[501].spans
    assert pii.find(docs_of(spark, [])).count() == 0
    assert pii.redact("a b@c.de f", [("email", 2, 8)]) == "a <email> f"


# ---- pipeline --------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as c
    assert [n for n, _ in c.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() > 0
        if name.startswith("n-gram"):
            kept = link_by_force([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for (i, _, root) in kept if i == root}
        if name == "PII":
            assert not [r for r in docs.collect() if spans_by_force(r.text)]
    ids = c.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count() and ids.filter("n_tokens < 2").count() == 0
    empty = docs.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_jaccard_long_texts_near_the_limit(spark):
    """Long texts that just miss or just reach the limit: what is stored per open group doesn't grow with the text."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(40_000)}" for _ in range(20_000)]

    def changed(k, share):
        words = list(base)
        for p in random.Random(k).sample(range(len(words)), int(len(words) * share)):
            words[p] = f"x{k}_{p}"
        return " ".join(words)

    rows = [(1, changed(1, .012), "a"), (2, changed(2, .012), "a"), (3, changed(3, .03), "a"), (4, changed(4, .03), "a"), (5, " ".join(base), "a")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, rows)).collect())
    assert got == link_by_force([(i, t) for i, t, _ in rows]) and len({c for _, _, c in got}) == 3


def test_very_long_digit_runs(spark):
    """Digit runs of thousands of signs end no query, in any kind."""
    zeros, nines = "0" * 5000, "9" * 5000
    rows = [(1, f"{zeros}.1.1.1 {zeros}7.{zeros}.2.{zeros}255 {nines}.1.1.1", "a"), (2, f"4{zeros} {nines} {'4111 ' * 2000}", "a"), (3, f"+1{zeros} +{nines} +1 {'2-' * 4000}3", "a"), (4, f"{'a' * 5000}@{nines}.{zeros}", "a")]
    got = {r.doc_id: r for r in pii.find(docs_of(spark, rows)).select("row.doc_id", "spans").collect()}
    for i, text, _ in rows:
        base = pii.base_spans(text)
        assert {(k, a, b) for k, a, b in base} <= {(s["kind"], s["start"], s["stop"]) for s in got[i].spans}
    assert sum(k == "ip" for k, _, _ in pii.base_spans(rows[0][1])) == 2


def test_word_hashes_name_words(monkeypatch):
    """One hash per word whatever stands around it, also where a text is read in segments."""
    words = [w.encode() for w in ("a", "b", "ab", "ba", "aa", "aaa", "é", "漢字", "x" * 500, "\x00", "\x01")]
    alone = {w: int(jaccard_join.word_hashes(w.decode())[0]) for w in words}
    assert len(set(alone.values())) == len(words) and alone[b"ab"] == int(jaccard_join.word_hashes(" AB\n")[0])
    rng = random.Random(1)
    text = "".join(rng.choice(words).decode() + rng.choice([" ", "\n", "\t\x0b ", "\r\n"]) for _ in range(3000))
    want = [alone[w] for w in text.encode().split()]
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(jaccard_join, "SEGMENT", size)
        assert jaccard_join.word_hashes(text).tolist() == want
    assert len(jaccard_join.word_hashes("")) == 0 == len(jaccard_join.word_hashes(" \n"))
