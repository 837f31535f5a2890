"""Operator 1: merge-type piece encoding by a prefix table, and decoding.

Every prefix of a text has one last token in its merge encoding.  An automaton lists the pieces that end at a
position; the one that may follow the last token of the prefix before it is the last token there.  Whether a piece
may follow another is decided by replaying both pieces' own merges side by side: the pair holds unless a merge
across their border would come first.  The ids are then read backwards from the end of the text.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadwake.llm.common import load, map_arrow

BAR = "▁"
CUT = "\x01"
#: Segments longer than this are encoded anew each time; between texts the memo holds so many shorter ones at most.
MEMO_CHARS, MEMO_SIZE = 48, 150_000
PAIR_SIZE = 400_000


class PieceCoder:
    """Encoder and decoder of one merge-type model; built once per worker from the model's bytes."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.id_of = {self.text[i]: i for i in range(size) if not special[i]}
        self.rank = {t: -sp.get_score(i) for t, i in self.id_of.items()}
        self.size = size
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.output = [b"" if sp.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of
                       else " ⁇ ".encode() if sp.is_unknown(i) else t.replace(BAR, " ").encode() for i, t in enumerate(self.text)]
        self.control = {i for i in range(size) if sp.is_control(i)}
        if any(re.search(f"[^{BAR}]{BAR}", t) for t in self.id_of):
            raise ValueError("pieces that continue over a word start are not supported")
        self.traces = {i: trace for t, i in self.id_of.items() if (trace := self._trace(t))}
        self.pairs: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        for i in self.traces:
            self.auto.add_word(self.text[i], (len(self.text[i]), i))
        self.auto.make_automaton()
        self.width = [len(t) for t in self.text]
        self.line_break = "\n" not in self.id_of and CUT not in self.id_of
        self.pattern = re.compile(rf"{BAR}+[^{BAR}\n]*|[^{BAR}\n]+|\n" if self.line_break else f"{BAR}+[^{BAR}]*|[^{BAR}]+")
        self.inside = {t[k:k + 2] for i in self.traces for t in [self.text[i]] for k in range(len(t) - 1)}
        self.memo: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.head, self.tail = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unk]

    def _trace(self, text: str):
        """A piece's own merges as (rank, left edge, right edge) after each, or None if they don't end in the piece."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best = min(((self.rank[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.rank), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            steps.append((best[0], parts[0], parts[-1]))
        return ((text[0], text[-1]), steps) if all(c in self.id_of for c in text) else None

    def _joins(self, left: int, right: int) -> bool:
        """Whether the merges of the two pieces' joint text leave the border between them."""
        a, b = self.traces[left], self.traces[right]
        edge_a, edge_b, i, j = a[0][1], b[0][0], 0, 0
        never = float("inf")
        while True:
            ra = a[1][i][0] if i < len(a[1]) else never
            rb = b[1][j][0] if j < len(b[1]) else never
            cross = self.rank.get(edge_a + edge_b, never)
            if ra <= cross and ra <= rb and ra < never:
                edge_a = a[1][i][2]
                i += 1
            elif cross <= rb and cross < never:
                return False
            elif rb < never:
                edge_b = b[1][j][1]
                j += 1
            else:
                return True

    def _fits(self, key: int) -> bool:
        """Whether a piece may follow another (0: the start or a character without piece); kept for the next time."""
        left, right = divmod(key, self.size)
        if len(self.pairs) >= PAIR_SIZE:
            self.pairs.clear()
        self.pairs[key] = fits = not left or self._joins(left, right)
        return fits

    def encode_segment(self, s: str) -> list[int]:
        n = len(s)
        last = [0] * (n + 1)
        known, size = self.pairs.get, self.size
        for end, (length, piece) in self.auto.iter(s):
            end += 1
            if not last[end]:
                key = last[end - length] * size + piece
                fits = known(key)
                if fits or fits is None and self._fits(key):
                    last[end] = piece
        out, i, width = [], n, self.width
        while i:
            piece = last[i]
            if piece:
                out.append(piece)
                i -= width[piece]
            else:
                out.extend(self._fallback(s[i - 1])[::-1])
                i -= 1
        out.reverse()
        return out

    def _encode_new(self, s: str) -> bytes:
        """Where no piece holds the last two characters, the last one is cut off, so "word," and "word." share work."""
        if len(s) > 1 and s[-2:] not in self.inside:
            return self._stem(s[:-1]) + self._stem(s[-1])
        return self._stem(s)

    def _stem(self, s: str) -> bytes:
        ids = self.stems.get(s)
        if ids is None:
            ids = array("I", self.encode_segment(s)).tobytes()
            if len(s) <= MEMO_CHARS:
                if len(self.stems) >= MEMO_SIZE:
                    self.stems.clear()
                self.stems[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, little-endian unsigned 32-bit.

        Merges never run on over a word start, so the text is cut there and each distinct segment is encoded once.
        """
        marked = BAR + text.replace(" ", BAR) if text else ""
        if not self.line_break or CUT in marked or BAR + BAR in marked:
            parts = self.pattern.findall(marked)
        else:
            parts = marked.replace(BAR, CUT + BAR).replace("\n", f"{CUT}\n{CUT}").split(CUT)
        memo = self.memo
        if len(memo) > MEMO_SIZE:
            memo.clear()
        long = []
        for s in {s for s in parts if s not in memo}:  # with the empty string, which has no ids
            memo[s] = self._encode_new(s)
            if len(s) > MEMO_CHARS:
                long.append(s)
        ids = b"".join([self.head, *map(memo.__getitem__, parts), self.tail])
        for s in long:
            del memo[s]
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids: controls vanish, one blank at the start goes, wrong bytes become U+FFFD."""
        seq = array("I", ids).tolist()
        start = next((k for k, i in enumerate(seq) if i not in self.control), len(seq))
        raw = b"".join(map(self.output.__getitem__, seq))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self._decode_runs(seq)
        return text[1:] if start < len(seq) and self.text[seq[start]].startswith(BAR) else text

    def _decode_runs(self, seq: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*seq, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:width]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    out.append("�")
                del run[:width]
            if i is not None:
                out.append(self.output[i].decode("utf-8"))
        return "".join(out)


_CODERS: dict[bytes, PieceCoder] = {}


def coder(model: bytes) -> PieceCoder:
    if model not in _CODERS:
        _CODERS[model] = PieceCoder(model)
    return _CODERS[model]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids[, decoded]) per row: ids as little-endian unsigned 32-bit integers in one binary value.

    A null text counts as empty: begin and end only.  Ids may be null or repeat; each row gives one row.  Other
    columns of the input are not read.  The model travels with the plan, so executors need no file.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        code = coder(model)
        for b in batches:
            ids = [code.encode(t or "") for t in b.column(1).to_pylist()]
            cols = {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary())}
            if decode:
                cols["decoded"] = pa.array([code.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(narrow, run, "doc_id long, ids binary" + ", decoded string" * decode)


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) per row; null ids give an empty text."""
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        code = coder(model)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "decoded": pa.array([code.decode(i or b"") for i in b.column(1).to_pylist()], pa.string())})

    return map_arrow(narrow, run, "doc_id long, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_model() -> bytes:
    import public_tokenizers

    return model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def op1(spark, sf_dir: str) -> DataFrame:
    return digests(encode(load(spark, sf_dir, "documents"), default_model(), decode=True))
