"""Spelling variants, benchmark passages and conversation repair against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadwake.llm import conversations, decontaminate, variants

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, word string, n long, node long, row string, runs string, pos int, key string, items string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "r", "s", 3, "k", "i") for i, t in rows], CLASH).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- 11 --------------------------------------------------------------------------------------
def near_by_force(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants_by_force(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    patterns = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            patterns[w[:k] + "*" + w[k + 1:]].add(w)  # replaced
            patterns["-" + w[:k] + w[k + 1:]].add(w)  # left out
    near = defaultdict(set)
    for p, some in patterns.items():
        if p[0] == "-" and p[1:] in n:
            for w in some:
                near[w].add(p[1:]), near[p[1:]].add(w)
        elif p[0] != "-":
            for a, b in itertools.permutations(some, 2):
                near[a].add(b)
    assert all(near_by_force(a, b) for a in near for b in near[a])
    form = {w: min(near[w], key=lambda u: (-n[u], u)) for w in near if near[w]}
    form = {w: u for w, u in form.items() if n[u] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def found_variants(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_variants_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = variants_by_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[1] is not None for w in want) > 20
    assert found_variants(variants.op11(spark, SF)) == want


def test_variants_edges(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    rows = [(None, None), (1, ""), (2, "12 345 ..."), (3, "Straße ÉCOLE École école écol×e écol÷e écolee 漢字lettre漢字lettre lettre naïve")] * 3
    rows += [(k, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(40))) for k in range(60)]
    rows += [(9, f"{long} {long[:17]}{long[18:]} {long[:3990]}Z{long[3991:]} x{long} {long}q {long[:2000]}zz{long[2000:]}")] * 3
    rows += [(k, "aaaaa aaaaaa aaaaaaa aaaaaaaa aabaaaa aaaaba baaaaa abcde abcdf abcdg " + "grundform " * 40 + "grundfrm " * 10 + "grundfm grundfm") for k in range(4)]
    want = variants_by_force(rows)
    assert found_variants(variants.variants(docs_of(spark, rows))) == want
    assert any(w[2] != w[1] and w[1] is not None for w in want)  # a chain of forms
    assert found_variants(variants.variants(docs_of(spark, rows[:1]))) == [] == found_variants(variants.variants(docs_of(spark, rows).limit(0)))


# ---- 12 --------------------------------------------------------------------------------------
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_force(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(lower(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        low = lower(text)
        at = [m.span() for m in WORDS.finditer(low)]
        w = [low[a:b] for a, b in at]
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= {str(i) for i in owners if i is not None}
        spans = [[k, k + 1] for k in sorted(hit)]
        for k in range(len(spans) - 1, 0, -1):
            if spans[k][0] == spans[k - 1][1]:
                spans[k - 1][1] = spans.pop(k)[1]
        out.append((doc, len(w), len(hit), sorted(ids), [(at[a][0], at[b - 1][1]) for a, b in spans]))
    return sorted(out, key=repr)


LEAK_ITEMS = [(1, "What is the capital of France, and how many people live in it today?"), (2, "four words are here"), (2, "four words are here"), (3, None), (4, " ,. "), (5, "é"),
              (6, "a b a b a b a b a b a b a b"), (None, "an item without id has words too"), (7, "WHAT IS the capital of france and how many people — live"), (8, "deep " * 400 + "end")]
LEAK_DOCS = [(1, None), (2, ""), (3, "\x00 ... \n"), (4, "x What IS--the capital\x00of\nfrance... AND how many PEOPLE live in it: today y z"), (4, "x What IS the capital"), (None, "Four WORDS are here. Four words are. here"),
             (5, "É é É"), (6, "b a " * 3000 + "four words are here"), (7, "an item without id has words too; an item"), (8, "🙂 an item WITHOUT id has words to"), (9, "deep " * 5000 + "end"), (9, "deep " * 5000 + "end"),
             (10, "what is the capital of france and how many people — live in it four words are here")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 3000])
def test_leaks_edges(spark, block):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in LEAK_ITEMS], "item_id long, text string, row string, window int").repartition(2)
    found = decontaminate.find(docs_of(spark, LEAK_DOCS), items, block_bytes=block)
    want = leaks_by_force(LEAK_DOCS, LEAK_ITEMS)
    got = sorted(((r.row.doc_id, r.n_words, r.n_hit, list(r["items"]), [(s.start, s.stop) for s in r.spans]) for r in found.collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    texts = {w[0]: t for w in want for i, t in LEAK_DOCS if i == w[0]}
    for g, w in zip(got, want):  # windows that only touch may be one span
        assert g[0] is None or [lower(texts[g[0]] or "")[a:b] for a, b in g[4]] == [lower(texts[w[0]] or "")[a:b] for a, b in w[4]]
    assert decontaminate.find(docs_of(spark, LEAK_DOCS).limit(0), items).count() == 0
    assert decontaminate.find(docs_of(spark, LEAK_DOCS), items.limit(0)).filter("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.find(docs_of(spark, LEAK_DOCS), items).select("row.*").columns == docs_of(spark, LEAK_DOCS).columns


def test_leaks_on_documents(spark):
    docs, items = ([(r[0], r.text) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    want = sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i, _ in leaks_by_force(docs, items))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op12(spark, SF).collect()) == want
    assert decontaminate.clean(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == sum(not w[-1] for w in want)


# ---- 13 --------------------------------------------------------------------------------------
def damage_by_force(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows, faults):
    """From left to right over (rows done, kind of the last turn), instead of intervals."""
    best = {(0, ""): (0, "", [])}  # last turn: "" none, s, u, a
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(at, new):
        if at not in best or new[:2] < best[at][:2]:
            best[at] = new

    for k in range(len(rows) + 1):
        for _ in range(4):
            for last in ("", "s", "u", "a"):
                if (k, last) in best:
                    cost, audit, lines = best[k, last]
                    for x in after[last]:
                        if x != "s":
                            better((k, x), (cost + 3, audit + "I", lines + [("user" if x == "u" else "assistant") + ":"]))
        if k == len(rows):
            break
        _, role, text = rows[k]
        for last in ("", "s", "u", "a"):
            if (k, last) in best:
                cost, audit, lines = best[k, last]
                better((k + 1, last), (cost + 4, audit + "D", lines))
                if faults[k] not in ("blank", "duplicate"):
                    more = 3 if faults[k] == "truncated" else 0
                    for x in after[last]:
                        if role[:1] == x:
                            better((k + 1, x), (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                        if x != "s":
                            better((k + 1, x), (cost + more + 3, audit + "R", lines + [("user:" if x == "u" else "assistant:") + text]))
    return min((best[len(rows), x] for x in ("", "a") if (len(rows), x) in best), key=lambda b: b[:2])


def every_edit(rows, faults):
    """All edits of very short conversations, one by one."""
    gaps = [("",), *[tuple(p) for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]]
    ways = []
    for (_, role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        ways.append([(4, "D", None)] + ([] if fault in ("blank", "duplicate") else [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]))
    best = None
    for picked in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for k in range(len(rows) + 1):
                for role in put[k]:
                    if role:
                        cost, audit = cost + 3, audit + "I"
                        turns.append((role, ""))
                if k < len(rows):
                    cost, audit = cost + picked[k][0], audit + picked[k][1]
                    turns += [picked[k][2]] if picked[k][2] else []
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
                best = (cost, audit, [f"{r}:{t}" for r, t in turns])
    return best


def repair_by_force(rows, solve=cheapest):
    seen, faults = set(), []
    for _, role, text in rows:
        signs = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = solve(rows, faults)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repair(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*r, 1, "k", "a") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string, audit string").repartition(3)
    want = {c: repair_by_force(r) for c, r in damage_by_force(rows).items()}
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversations.repair(conversations.damaged(df)).collect()}
    assert got == want
    lines = conversations.repaired(conversations.damaged(df)).orderBy("conv_id", "place").collect()
    for c, w in want.items():
        mine = [r for r in lines if r.conv_id == c]
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == w[-1]
    return want


def random_rows(seed, n, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Go on!", "and then ", None, "Fin. \n", "a\nb."]
    return [(rng.choice([*range(n), None]), rng.choice([*range(length), None]), rng.choice(["user", "assistant", "system", "tool", "", None, "unit"]), rng.choice(texts)) for _ in range(n * length)]


def test_repair_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", "Why?"])) for k in range(rng.randint(0, 3))]
        seen = repair_by_force(rows)
        assert seen == repair_by_force(rows, every_edit)
        said = [(r, t) for _, r, t in rows]
        found = conversations.faults(said)
        assert conversations.accepted(conversations.parsed([conversations.turn_cell(r[:1], f) for (r, _), f in zip(said, found)])) == seen[5:7]
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"{k}?"])) for k in range(rng.randint(4, 70))]
        said = [(r, t) for _, r, t in rows]
        assert conversations.accepted(conversations.parsed([conversations.turn_cell(r[:1], f) for (r, _), f in zip(said, conversations.faults(said))])) == repair_by_force(rows)[5:7]


def test_repair_edges(spark):
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    want = check_repair(spark, random_rows(1, 40, 9) + [(1000, 0, "user", "word " * 20_000), (gone, 0, "user", "Yes.")])
    assert None in want and any(w[6] == "" for w in want.values())  # one whose rows are all dropped
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(empty)).count() == 0


def test_repair_of_long_conversations(spark, monkeypatch):
    for name, value in (("LONG_ROWS", 6), ("CHUNK", 4), ("FAN", 3)):
        monkeypatch.setattr(conversations, name, value)
    rows = random_rows(7, 5, 30) + [(50, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(90)] + [(51, k * 0, "tool", "") for k in range(20)]
    check_repair(spark, rows)


def test_repair_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: repair_by_force(r) for c, r in damage_by_force(rows).items()}
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversations.op13(spark, SF).collect()}
    assert got == want and len({w[6] for w in want.values()}) > 5
