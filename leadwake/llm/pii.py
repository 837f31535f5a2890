"""Operator 10: personal data by fixed patterns and a semi-Markov conditional random field.

Four base patterns give spans that always stay.  Around digits and at-signs outside of them, a semi-Markov field scores
whole candidate segments (shape, digit count, checksum, separators, words beside it) for each type, and a dynamic program
over segments of bounded length chooses borders and types together.  It is fitted on windows from a bounded sample of the
given documents: base spans, rewritten forms of them ("name (at) host dot org", grouped digits) and broken forms as
counter-examples.  A segment is added where its posterior probability reaches ``CERTAIN``.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import load, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Documents sampled for the fit and windows used of them, at most (documented bounds); rounds over the windows.
FIT_DOCS, FIT_WINDOWS, ROUNDS = 4_000, 1_200, 12
#: Tokens in an entity at most; characters read on either side of a trigger; posterior from which a segment is added.
LONGEST, REACH, CERTAIN = 14, 48, 0.95

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|_|\w")
_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.I)
_CUES = frozenset("tel phone call fax mobile mail email contact ip host server card visa account".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and then start; linear in the length of the text."""
    out, free, before = [], 0, 0
    at = text.find("@")
    while at >= 0:
        lead = text[max(free, before):at]
        start = at - (len(lead) - len(lead.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        before = at + 1
        at = text.find("@", before)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _windows(text: str, spans) -> list[tuple[int, int]]:
    """Stretches around the triggers that no base span covers, to the next white space, joined where they meet."""
    covered = sorted((a, b) for _, a, b in spans)
    out, k = [], 0
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if out and p < out[-1][1] - REACH:
            continue
        while k < len(covered) and covered[k][1] <= p:
            k += 1
        if any(a <= p < b for a, b in covered[k:k + 4]):
            continue
        a, b = max(0, p - REACH), min(len(text), p + 2 * REACH)
        while a > 0 and p - a < 2 * REACH and not text[a - 1].isspace():
            a -= 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _address(s: str) -> str:
    """Whether what stands before and after the at-sign reads as a name and a host."""
    name, host = (_AT.split(s) if "@" not in s else s.split("@"))[:2]
    whole = re.fullmatch(r"[\w-]+((\.| dot )[\w-]+)+", host.strip())
    return f"name={bool(re.fullmatch(r'[\w.%+-]+', name.strip()))},host={bool(whole)},end={bool(re.search(r'(\.| dot )[^\W\d_]{2,6}$', s))}"


def _candidates(text: str, blocked=()) -> tuple[int, list]:
    """Number of tokens, and (first, last + 1, kind, start, end, features) of every segment that could be an entity."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    out = []
    for i, (start, _) in enumerate(tokens):
        if not (words[i][0].isalnum() or words[i] in "+("):
            continue
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            end = tokens[j - 1][1]
            if not words[j - 1][-1].isalnum() or any(a < end and start < b for a, b in blocked):
                continue
            s = text[start:end]
            if "\n" in s:
                break
            d = _digits(s)
            plain = not s.strip("0123456789 ().+-/")
            signs = s.count("@") + len(_AT.findall(s))
            kinds = []
            if signs == 1 and words[i][0].isalnum() and re.search(r"\.| dot ", s) and re.fullmatch(r"[\w.%+@(\[{)\]} -]+", s):
                kinds.append("email")
            if plain and re.fullmatch(r"[0-9]{1,4}( ?[.-] ?[0-9]{1,4}){3}", s):
                kinds.append("ip")
            if plain and 14 <= len(d) <= 19 and "+" not in s:
                kinds.append("card")
            if plain and 7 <= len(d) <= 15:
                kinds.append("phone")
            if kinds:
                left, right = words[i - 1].lower() if i else "", words[j] if j < len(words) else ""
                shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}" if plain else "d", s))
                parts = [p for p in re.split(r"[^0-9]+", s) if p]
                common = ["bias", f"shape={shape[:40]}", f"digits={len(d)}", f"tokens={j - i}", f"cue={left in _CUES}",
                          f"left={'d' if left[:1].isdigit() else 'a' if left[:1].isalpha() else left[:1]}", f"right={'d' if right[:1].isdigit() else 'a' if right[:1].isalpha() else right[:1]}",
                          f"touch={start > 0 and not text[start - 1].isspace()}{end < len(text) and text[end:end + 1].isalnum()}",
                          f"spaces={min(s.count(' '), 9)}", f"first={words[i] if words[i] in '+(' else 'x'}"]
                for kind in kinds:
                    own = {"card": f"luhn={len(d) >= 16 and luhn(d)}", "ip": f"octets={len(parts) == 4 and all(int(p) <= 255 for p in parts)}",
                           "email": _address(s) if kind == "email" else "", "phone": f"groups={','.join(str(len(p)) for p in parts)[:12]}"}[kind]
                    out.append((i, j, kind, start, end, [f"{kind}:{f}" for f in (*common, own)]))
    return len(tokens), out


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _lattice(n: int, cands: list, scores: list[float]):
    """Log partition and each candidate's posterior, over all ways to cut the tokens into entities and single other tokens."""
    ends, starts = defaultdict(list), defaultdict(list)
    for k, c in enumerate(cands):
        ends[c[1]].append(k)
        starts[c[0]].append(k)
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_add([ahead[j - 1], *(ahead[cands[k][0]] + scores[k] for k in ends[j])]) if ends[j] else ahead[j - 1]
    for i in range(n - 1, -1, -1):
        back[i] = _log_add([back[i + 1], *(back[cands[k][1]] + scores[k] for k in starts[i])]) if starts[i] else back[i + 1]
    return ahead[n], [math.exp(min(0.0, ahead[c[0]] + s + back[c[1]] - ahead[n])) for c, s in zip(cands, scores)]


def _best(n: int, cands: list, scores: list[float]) -> list[int]:
    """The highest-scoring segmentation's entities."""
    ends = defaultdict(list)
    for k, c in enumerate(cands):
        ends[c[1]].append(k)
    best, choice = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ends[j]:
            if best[cands[k][0]] + scores[k] > best[j]:
                best[j], choice[j] = best[cands[k][0]] + scores[k], k
    out, j = [], n
    while j > 0:
        k = choice[j]
        if k >= 0:
            out.append(k)
        j = cands[k][0] if k >= 0 else j - 1
    return out[::-1]


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights that raise the conditional likelihood of the marked segments (Adagrad with a light decay)."""
    weights, seen = defaultdict(float), defaultdict(lambda: 1e-6)
    data = []
    for text, gold in examples:
        n, cands = _candidates(text)
        if cands:
            marked = set(gold)
            data.append((n, cands, [(c[2], c[3], c[4]) in marked for c in cands]))
    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(data)
        for n, cands, gold in data:
            scores = [sum(weights[f] for f in c[5]) for c in cands]
            _, post = _lattice(n, cands, scores)
            step = defaultdict(float)
            for c, g, p in zip(cands, gold, post):
                if abs(g - p) > 1e-4:
                    for f in c[5]:
                        step[f] += g - p
            for f, v in step.items():
                v -= 1e-3 * weights[f]
                seen[f] += v * v
                weights[f] += 0.5 * v / math.sqrt(seen[f])
    return {f: w for f, w in weights.items() if abs(w) > 1e-6}


def _rewritten(kind: str, s: str, rng: random.Random) -> list[tuple[str, bool]]:
    """Other forms of a base span, and broken ones (False) that are not personal data."""
    d = _digits(s)
    if kind == "email":
        name, host = s.split("@")
        return [(f"{name} {a} {host.replace('.', dot)}", True) for a in ("(at)", "[at]") for dot in (" dot ", ".")] + [(f"{name} {host}", False)]
    if kind == "ip":
        parts = s.split(".")
        return [(" . ".join(parts), True), (".".join([*parts[:3], str(300 + rng.randrange(600))]), False)]
    if kind == "card":
        sep = rng.choice("./")
        return [(sep.join(d[k:k + 4] for k in range(0, len(d), 4)), True), (d[:-1] + str((int(d[-1]) + 1 + rng.randrange(8)) % 10), False)]
    return [(f"({d[:3]}) {d[3:6]}-{d[6:]}", True), (d, False), (f"{d[:4]}-{d[4:6]}", False)]


def _examples(text: str, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training windows of a text: base spans as they are and rewritten, and stretches with digits but no span."""
    spans, rng, out = base_spans(text), random.Random(seed), []
    for kind, a, b in spans[:4]:
        left, right = text[max(0, a - REACH):a], text[b:b + REACH]
        inside = [x for x in spans if x[1] >= a - len(left) and x[2] <= b + len(right)]
        if len(inside) == 1:
            for s, good in [(text[a:b], True), *_rewritten(kind, text[a:b], rng)]:
                out.append((left + s + right, [(kind, len(left), len(left) + len(s))] if good else []))
    out += [(text[a:b], []) for a, b in _windows(text, spans)[:2] if not any(x[1] < b and a < x[2] for x in spans)]
    number = "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 18)))
    middle = len(text) // 2
    if text and not any(x[1] < middle + REACH and middle - REACH < x[2] for x in spans):
        out.append((text[max(0, middle - REACH):middle] + f" {number} " + text[middle:middle + REACH], []))
    return [(t, gold) for t, gold in out if not (set(base_spans(t)) - set(gold))]


def learn(docs: DataFrame) -> dict[str, float]:
    """Fit on windows of at most ``FIT_DOCS`` documents, chosen by the hash of their id."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(FIT_DOCS)
    some = docs.join(F.broadcast(ids), "doc_id")  # FIT_DOCS ids at most

    def run(batches):
        for b in batches:
            got = [e for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in _examples(t or "", d or 0)]
            yield pa.RecordBatch.from_pydict({"window": [t for t, _ in got], "kind": pa.array([g[0][0] if g else None for _, g in got], pa.string()),
                                              "start": pa.array([g[0][1] if g else None for _, g in got], pa.int32()), "stop": pa.array([g[0][2] if g else None for _, g in got], pa.int32())})

    windows = map_arrow(some, run, "window string, kind string, start int, stop int")
    rows = windows.orderBy(F.xxhash64("window"), "window", "start").limit(FIT_WINDOWS).collect()
    return fit([(r.window, [(r.kind, r.start, r.stop)] if r.kind else []) for r in rows])


def added_spans(text: str, spans, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    out = []
    for a, b in _windows(text, spans):
        blocked = [(x - a, y - a) for _, x, y in spans if x < b and a < y]
        n, cands = _candidates(text[a:b], blocked)
        if not cands:
            continue
        scores = [sum(weights.get(f, 0.0) for f in c[5]) for c in cands]
        _, post = _lattice(n, cands, scores)
        out += [(cands[k][2], a + cands[k][3], a + cands[k][4]) for k in _best(n, cands, scores) if post[k] >= CERTAIN]
    return out


def all_spans(text: str | None, weights: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """Base spans and those that the field adds, by kind as listed and then start; the last item tells base ones."""
    base = base_spans(text) if text else []
    more = added_spans(text, base, weights) if text and weights else []
    return sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """row and spans, an array of (kind, start, stop, base) in code points, by kind as listed and then start.

    ``row`` is the whole input row as a struct, so other columns may have any name.  A null or empty text has no spans.
    Rows with equal ids are searched one by one.  Without documents to learn from only base spans are found.
    """
    model = learn(_plain(docs, id_col, text_col)) if weights is None else weights
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])

    @F.arrow_udf("array<struct<kind:string,start:int,stop:int,base:boolean>>")
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "stop", "base"), s)) for s in all_spans(t, model)] for t in texts.to_pylist()], pa.list_(item))

    _short_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row")).withColumn("spans", search(F.col(f"row.{text_col}").cast("string")))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """row and redacted, the text without the spans that ``find`` gives; a null text stays null.

    Search and replacement are one Python step: a second one over the spans would hold a second worker beside each task, and
    both live on into later stages with what those load.
    """
    model = learn(_plain(docs, id_col, text_col)) if weights is None else weights

    @F.arrow_udf("string")
    def cover(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t, [s[:3] for s in all_spans(t, model)]) for t in texts.to_pylist()], pa.string())

    _short_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row")).withColumn("redacted", cover(F.col(f"row.{text_col}").cast("string")))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _short_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(512, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become the first one's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    got = find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS],
                      F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
