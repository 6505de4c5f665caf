"""Token counts by prefix dynamic programming: the exact count at every prefix, so truncation and budgets need no second encoding.

A byte-pair encoding merges the neighbours whose joint piece has the best score, the leftmost of equals. Its result has
a local test: a row of pieces is the encoding of its text exactly if each two neighbours are the encoding of theirs.
So among the pieces that end at a prefix only one can follow the last piece of the shorter prefix it leaves, and

    last(p) = that piece,    count(p) = count(p without that piece) + 1

fill a table from left to right. Texts are cut beforehand between characters that stand side by side in no piece, which
no merge can cross; parts that were met before come from a bounded store. A character of no piece counts its bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import remembered, text_of

#: How the model writes a space; here both are spaces.
_BAR, SPACE = "▁", " "
#: Parts that a worker remembers twice over (about 100 MB in all), and pairs of pieces; beyond that the older half, or
#: all pairs, go, which only costs time.
PARTS, PAIRS = 250_000, 300_000
#: Longer parts are worked out each time.
LONGEST_KEPT = 64
#: Parts that begin with the same so many characters share their first rows.
HEAD, HEADS = 5, 50_000
#: A step is one signed byte; this one says that the true step, which does not fit, is among the wide ones.
_WIDE, _WIDE_BYTE = -128, b"\x80"


class Pieces:
    """What a sentencepiece BPE model says: pieces with their scores, and which characters ever stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i).replace(_BAR, SPACE): model.get_score(i) for i in normal}
        self.joins = {p[i: i + 2] for p in self.score for i in range(len(p) - 1)}
        # how long the pieces are that end in these two characters, or are this one
        self.reach: dict[str, int] = {}
        alone = set()
        for piece in self.score:
            self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 1))
            if len(piece) > 1:
                alone.update(piece)
        # ASCII characters that stand in no longer piece end a part on both sides; so does the start of each run of spaces
        lone = "".join(f"\\x{i:02x}" for i in range(128) if chr(i) not in alone and chr(i) != SPACE)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else ""))
        # prefixes are cut at every space, so no piece may go on behind one
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces of this model reach over spaces")
        if model.encode("a  b ", out_type=str) != model.encode(f"a{_BAR}{_BAR}b{_BAR}", out_type=str) or model.encode("Ａ", out_type=str) == model.encode("A", out_type=str):
            raise ValueError("this model rewrites texts before it cuts them")

        self._edges: dict[str, tuple[list, list] | None] = {}

    def edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the piece's right and at its left end while it is merged from characters, each with the score
        at which it goes; None if its characters merge to something else.

        A merge that becomes possible late goes at once, so the score at which things go never rises.
        """
        if piece not in self._edges:
            self._edges[piece] = self._merged(piece)
        return self._edges[piece]

    def _merged(self, text: str) -> tuple[list, list] | None:
        parts, score, falling = list(text), self.score, math.inf
        right, left = [], []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            falling = min(falling, best)
            if at == 0:
                left.append((parts[0], falling))
            if at == len(parts) - 2:
                right.append((parts[-1], falling))
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return right + [(text, -math.inf)], left + [(text, -math.inf)]

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether the two are the encoding of their text: no merge over their border has its turn before either side moves on.

        Of equal scores the leftmost merge goes first: that inside ``before``, then that over the border.
        """
        b = self.edges(piece)
        if b is None or not before:
            return b is not None
        a = self.edges(before)
        if a is None:
            return False
        (right, _), (_, left), score = a, b, self.score
        i = j = 0
        while True:
            (r, r_goes), (l, l_goes) = right[i], left[j]
            s = score.get(r + l)
            if s is not None and s > r_goes and s >= l_goes:
                return False
            if r_goes == l_goes == -math.inf:
                return True
            if r_goes >= l_goes:
                i += 1
            else:
                j += 1


class PrefixCounter:
    """Steps of the token count from prefix to prefix, one signed byte per code point."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.steps_of: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list[str], list[int]]] = {}
        self.wide: list[int] = []

    def _may_follow(self, before: str, piece: str) -> bool:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        ok = self.follows[before, piece] = self.pieces.may_follow(before, piece)
        return ok

    def table(self, part: str) -> tuple[list[str], list[int]]:
        """The last piece and the count of each prefix of a part that merges don't leave.

        Parts that begin alike share the rows of their first characters.
        """
        n = len(part)
        if n > HEAD:
            head = self.heads.get(part[:HEAD])
            if head is None:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                head = self.heads[part[:HEAD]] = self.table(part[:HEAD])
            last, count = head[0].copy(), head[1].copy()
        else:
            last, count = [""], [0]
        score, reach, follows = self.pieces.score, self.pieces.reach, self.follows
        for end in range(len(last), n + 1):
            far = reach.get(part[end - 2: end] if end > 1 else part[0], 1)
            for at in range(end - far if end > far else 0, end):
                piece = part[at:end]
                if piece in score:
                    before = last[at]
                    ok = follows.get((before, piece))
                    if ok is None:
                        ok = self._may_follow(before, piece)
                    if ok:
                        last.append(piece)
                        count.append(count[at] + 1)
                        break
            else:
                # bytes stand for a character of no piece; nothing merges with it
                last.append("")
                count.append(count[-1] + len(part[end - 1].encode()))
        return last, count

    def _kept(self, text: str, steps: bytes) -> bytes:
        if len(text) <= LONGEST_KEPT and _WIDE_BYTE not in steps:
            if len(self.steps_of) >= PARTS:
                self.older = self.steps_of.copy()
                self.steps_of.clear()
            self.steps_of[text] = steps
        return steps

    def _of_part(self, part: str) -> bytes:
        steps = self.older.get(part)
        if steps is not None:
            return self._kept(part, steps)
        _, count = self.table(part)
        steps = [b - a for a, b in zip(count, count[1:])]
        if min(steps) <= _WIDE or max(steps) > 127:
            self.wide += [s for s in steps if not _WIDE < s <= 127]
            steps = [s if _WIDE < s <= 127 else _WIDE for s in steps]
        return self._kept(part, bytes([s & 255 for s in steps]))

    def _of_chunk(self, chunk: str) -> bytes:
        steps = self.older.get(chunk)
        if steps is not None:
            return self._kept(chunk, steps)
        joins, parts, at = self.pieces.joins, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1: i + 1] not in joins:
                parts.append(chunk[at:i])
                at = i
        if not at:
            return self._of_part(chunk)
        parts.append(chunk[at:])
        known = self.steps_of
        return self._kept(chunk, b"".join([known.get(p) or self._of_part(p) for p in parts]))

    def steps(self, text: str) -> tuple[bytes, list[int]]:
        """One step per code point of ``text``, whose running sums are the counts of all its prefixes, and the wide ones."""
        self.wide = []
        if not text:
            return b"", self.wide
        known = self.steps_of
        out = b"".join([known.get(c) or self._of_chunk(c) for c in self.pieces.parts.findall(SPACE + text.replace(_BAR, SPACE))])
        # the space put in front is no prefix of its own: its tokens, a few at most, join the step of the first character
        both = out[0] + int.from_bytes(out[1:2], "little", signed=True)
        if out[1:2] == _WIDE_BYTE:
            self.wide[0] += out[0]
            return out[1:], self.wide
        if both > 127:
            self.wide.insert(0, both)
            both = _WIDE
        return bytes([both & 255]) + out[2:], self.wide


def counter_of(path: str) -> PrefixCounter:
    """The worker's own, with what it remembers of earlier tasks; another model or operator takes its place."""
    return remembered(f"prefix counts {path}", lambda: PrefixCounter(Pieces(path)))


def counts_at_prefixes(steps: bytes, wide) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    a = np.frombuffer(steps, np.int8).astype(np.int64)
    if wide is not None and len(wide):
        a[a == _WIDE] = np.asarray(wide, np.int64)
    return np.concatenate([[0], np.cumsum(a)])


_SHAPE = "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary, wide array<int>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        names = [f.split()[0] for f in _SHAPE.split(", ")]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                small, wide = counter.steps(text)
                rows.append((doc_id.as_py(), len(text.encode()), len(text), int(counts_at_prefixes(small, wide)[-1]), small, wide))
                held += len(small)
                if held > 8_000_000 or len(rows) >= 10_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return run


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_chars, n_tokens, steps, wide``: the whole text's count, and the table behind it.

    ``model`` is the path of a sentencepiece BPE model that leaves texts as they are but for spaces. ``steps`` holds one signed byte per code point: how the
    count changes from the prefix before it; a step that fits no byte stands in ``wide``. Read it with
    ``tokens_before`` and ``longest_prefix``. No begin, end or added special tokens; special strings inside a text are
    text. Null and empty texts have no tokens; a null doc_id stays null; repeated rows are counted each; an empty table
    gives no rows; other columns are left out. A long text is worked through whole, in time linear in its length.
    """
    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(_count(model), _SHAPE)


@pandas_udf(T.LongType())
def tokens_before(steps: pd.Series, wide: pd.Series, position: pd.Series) -> pd.Series:
    """Tokens of the first ``position`` code points; of the whole text beyond its end."""
    out = [counts_at_prefixes(s, w) for s, w in zip(steps, wide)]
    return pd.Series([int(c[min(max(int(p), 0), len(c) - 1)]) for c, p in zip(out, position)])


@pandas_udf(T.LongType())
def longest_prefix(steps: pd.Series, wide: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix whose count is within the budget; null without steps."""
    return pd.Series([None if s is None else int(np.flatnonzero(counts_at_prefixes(s, w) <= max(int(b), 0))[-1])
                      for s, w, b in zip(steps, wide, budget)], dtype="Int64")


def budgeted(prefixes: DataFrame, limit: int) -> DataFrame:
    """Adds ``over_limit`` and ``fits_chars``, the longest prefix within ``limit`` tokens; texts within it fit whole."""
    over: Column = F.col("n_tokens") > limit
    # only the tables of texts beyond the limit are read
    cut = longest_prefix(F.when(over, F.col("steps")), F.when(over, F.col("wide")), F.lit(limit))
    return prefixes.withColumns({"over_limit": over, "fits_chars": F.coalesce(cut, F.col("n_chars"))})
