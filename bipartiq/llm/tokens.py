"""Token ids of every text by a public byte-level BPE, through prefix dynamic programming.

A BPE encoding is valid exactly if each two neighbouring tokens would stay apart
when merged on their own, and every byte string has one valid encoding only. So
for each prefix of a piece it is enough to store the last token of the prefix's
encoding: it is the one token that ends there and may follow the last token of
what is left of it. Going back over these tokens gives the ids. Nothing that is
stored changes when bytes are appended, so an append costs its own bytes, and an
edit costs the pieces from the edit on, up to where the old pieces line up again.

Texts are first cut into pieces by the tokenizer's own pattern. Pieces repeat as
words do, so their ids are remembered per worker and the programming runs for
new pieces alone. A text is never cut at a length; the ids of a null text and of
an empty one are the empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from bipartiq.session import ship, slices

#: Where the vocabulary files lie, and the file used; both are parameters of every function.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS_PER_BATCH = 512
#: Pieces that a worker remembers; it forgets them all beyond, which costs time only.
REMEMBERED = 300_000


class PrefixEncoder:
    """Encodes pieces by the last token of each prefix."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: What some token ends with: a longer reach backwards can't be a token.
        self.endings = {token[i:] for token in self.ranks for i in range(len(token))}
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, list[int]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, ...]] = {}

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The encoding by its definition: always merge the pair of least rank, leftmost first; not below ``until`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks, none = self.ranks, 1 << 60
        costs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while len(parts) > until:
            least = min(costs, default=none)
            if least == none:
                break
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, ...]:
        """The two tokens whose merge makes a token; a byte alone is itself; nothing if merging its bytes doesn't give it."""
        found = self._halves.get(token)
        if found is None:
            data = self.tokens[token]
            parts = self.merged(data, 2)
            good = len(data) == 1 or (len(parts) == 2 and self.ranks.get(self.tokens[parts[0]] + self.tokens[parts[1]]) == token)
            found = self._halves[token] = tuple(parts) if good else ()
        return found

    def whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        return bool(self.halves(token))

    def apart(self, first: int, second: int) -> bool:
        """Whether two tokens in a row stay as they are when their bytes are merged.

        Merging is run backwards at the border alone: of the two parts that meet there
        the one merged last is undone, and what it leaves at the border must not have
        merged across before. At equal ranks the merge further left came first.
        """
        pair = (first, second)
        known = self._apart.get(pair)
        if known is None:
            left, right, before = first, second, 1 << 60
            while True:
                if self.ranks.get(self.tokens[left] + self.tokens[right], 1 << 60) < before:
                    known = False
                    break
                from_left, from_right = self.halves(left), self.halves(right)
                if len(from_left) == len(from_right) == 1:
                    known = True
                    break
                if len(from_right) == 1 or (left > right and len(from_left) == 2):
                    left, before = from_left[1], left
                else:
                    right, before = from_right[0], right + 1
            if len(self._apart) >= 2_000_000:
                self._apart.clear()
            self._apart[pair] = known
        return known

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """Last tokens of the prefixes of data; those up to ``start`` bytes are in ``last`` already."""
        ranks, tokens, endings = self.ranks, self.tokens, self.endings
        for end in range(start + 1, len(data) + 1):
            for begin in range(end - 1, max(end - self.longest, 0) - 1, -1):
                part = data[begin:end]
                if part not in endings:
                    raise ValueError("no valid last token")  # pragma: no cover - every byte is a token
                token = ranks.get(part)
                if token is None or not self.whole(token):
                    continue
                if begin == 0 or self.apart(last[begin - 1], token):
                    last.append(token)
                    break
        return last

    def backwards(self, last: list[int]) -> list[int]:
        """The ids that the stored last tokens stand for."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        ids.reverse()
        return ids

    def piece(self, text: str) -> list[int]:
        found = self.pieces.get(text)
        if found is None:
            data = text.encode("utf-8", "surrogatepass")
            token = self.ranks.get(data)
            found = [token] if token is not None and self.whole(token) else self.backwards(self.extend(data, []))
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            if len(text) <= 256:
                self.pieces[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and for an empty text."""
        if not text:
            return []
        ids: list[int] = []
        known, new = self.pieces, self.piece
        for part in self.split(text):
            ids += known.get(part) or new(part)
        return ids


class EncodedText:
    """A text with its pieces and their stored prefixes, for exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.parts: list[str] = []
        self.last: list[list[int]] = []
        #: Bytes whose last token was looked for, over all operations.
        self.work = 0
        self.replace(0, 0, text)

    def _stored(self, part: str, like: int | None) -> list[int]:
        """Last tokens of a piece, going on from those of an old piece that it begins with."""
        data, last = part.encode("utf-8", "surrogatepass"), []
        if like is not None and part.startswith(self.parts[like]):
            last = list(self.last[like])
        self.work += len(data) - len(last)
        return self.encoder.extend(data, last, len(last))

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start to end.

        Pieces that end two pieces before the change can't depend on it: the pattern
        looks one character past a piece, and a piece of spaces may give its last
        one to the next. Pieces behind the change are kept from the first that
        starts where an old one did.
        """
        text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep + 2 < len(self.starts) and self.starts[keep + 2] < start:
            keep += 1
        begin = self.starts[keep] if keep < len(self.starts) else 0
        old = {s: i for i, s in enumerate(self.starts) if s >= end}
        shift = len(new) - (end - start)
        starts, parts, last = self.starts[:keep], self.parts[:keep], self.last[:keep]
        at = begin
        for match in _pieces(text, begin):
            i = old.get(at - shift)
            if i is not None and at - shift > end:
                starts += [s + shift for s in self.starts[i:]]
                parts += self.parts[i:]
                last += self.last[i:]
                break
            like = len(parts) if len(parts) < len(self.parts) and self.starts[len(parts)] == at else None
            last.append(self._stored(match, like))
            starts.append(at)
            parts.append(match)
            at += len(match)
        self.text, self.starts, self.parts, self.last = text, starts, parts, last

    def append(self, new: str) -> None:
        self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        return [token for last in self.last for token in self.encoder.backwards(last)]


def _pieces(text: str, begin: int) -> Iterator[str]:
    import regex

    for match in regex.compile(PATTERN).finditer(text, begin):
        yield match.group()


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixEncoder:
    """One encoder per worker and vocabulary."""
    return PrefixEncoder(path)


def encode_corpus(
    df: DataFrame, ident: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``ident`` and ``ids`` of every row; repeated and null ids each keep their rows."""
    return _per_text(df, [ident], text, f"{tokenizers}/{vocabulary}", "ids array<int>", lambda e, t: e.encode(t), pa.list_(pa.int32()))


def token_counts(
    df: DataFrame, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The ``keep`` columns and ``tokens``, the number of each text's ids, of every row."""
    return _per_text(df, keep, text, f"{tokenizers}/{vocabulary}", "tokens int", lambda e, t: len(e.encode(t)), pa.int32())


def _per_text(df, keep, text, path, field, compute, kind) -> DataFrame:
    ship(df.sparkSession)
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, TEXTS_PER_BATCH):
            values = [compute(own, t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, kind)], names=[*keep, name])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}, {field}")
