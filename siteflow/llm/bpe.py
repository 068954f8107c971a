"""BPE encoding and decoding with the tokenizers library, by tree concatenation for long texts.

A text up to ``long_chars`` is encoded as it is. A longer one is cut into leaves of equal length, with no
regard to words; the leaves are rows that Spark deals out and encodes in parallel, and pairs of neighbours are
joined level by level. At a join a window around the cut is encoded again and grows until a run of its tokens
equals the left side's and another the right side's, in ids and places; between these runs the window's tokens
count. If no window agrees, the two sides' text is encoded as one.

Why this is exact: BPE's result is the sequence whose neighbouring tokens all stay apart when they are encoded
as pairs. Every neighbouring pair of the joined sequence stands in one of the three encodings.

The library is asked once for each distinct piece between boundaries that its pre-tokenizer always makes
(``Encoder``), which is where nearly all of its time goes. For a byte-level one, and for one that lowers words and drops
blanks, these are found by columns.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, settle, tick

#: Without U+0130: in lower case it ends with a combining dot, which a pre-tokenizer joins with signs that follow.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Texts with any other character, or with a special token's opening, are given to the library whole.
UNUSUAL = re.compile(rf"<\||[^\n\r\t\x20-\x7e{LETTERS}¡-¿×÷–—‘’“”…€]")
#: Pieces whose ends are boundaries of the pre-tokenizer. Blanks belong to the next piece, or are dropped.
BLANKS_COUNT = re.compile(rf" ?[{LETTERS}]+(?=[ \n.,;:!?|*#$%&]|$)|[.,;:!?|*#$%&]+(?=[ \n]|$)| ?[^\s]+|\s+(?!\S)|\s+")
BLANKS_DROP = re.compile(rf"[{LETTERS}]+(?=[ \n.,;:!?|*#$%&]|$)|[.,;:!?|*#$%&]+(?=[ \n]|$)|[^\s]+")
#: ASCII that is not unusual; white space, signs and letters among it.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F)])
#: What a tokenizer that lowers words and drops blanks says of itself, if its words can be given to its model one by one.
FOLDS = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
DROPS = (r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), """ "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])")
WHITE, SIGN, LETTER = (np.isin(np.arange(256), list(x)) for x in (b" \n\r\t", b".,;:!?|*#$%&", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def unusual(text: str) -> bool:
    if text.isascii():
        return "<|" in text or bool(text.encode().translate(None, PLAIN))
    return UNUSUAL.search(text) is not None


def boundaries(data: np.ndarray, starts: np.ndarray, drop: bool = False) -> np.ndarray:
    """Where pieces of usual texts begin in their UTF-8, one text after another: boundaries that a byte-level pre-tokenizer always makes.

    White space is apart from what stands before it, and its last character, where something follows, from the rest of it; a blank
    then belongs to what follows. Signs are apart from a letter before them. With ``drop`` white space is no piece's.
    """
    white, letter = WHITE[data], LETTER[data]
    if len(data) and data.max() > 0x7F:  # letters of two bytes: U+00C0 to U+024F but for two signs
        two = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        letter[1:] |= two
    at = np.zeros(len(data) + 1, dtype=bool)
    at[1:-1] = white[1:] & ~white[:-1]
    at[1:-1] |= SIGN[data[1:]] & letter[:-1]
    if drop:
        at[1:-1] |= white[:-1]
        at[starts] = True
        at[:-1] &= ~white
        at[-1] = False
        return np.flatnonzero(at)
    at[1:-1] |= ~white[1:] & white[:-1] & (data[:-1] != 0x20)
    ends = starts[(starts > 0) & (starts < len(data))]
    last = white[:-1] & ~white[1:]
    last[ends - 1] = False  # what follows is another text
    at[:-2] |= last
    at[starts] = True
    at[-1] = False
    return np.flatnonzero(at)


def byte_alphabet() -> dict[int, str]:
    """The character that a byte-level model has for each byte: printable ones stay, the others follow from U+0100 on."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = [b for b in range(256) if b not in stay]
    return {b: chr(0x100 + k) for k, b in enumerate(moved)}


class Pieces(dict):
    """The ids of pieces, encoded when first asked for. A full cache becomes the older one, which is asked before encoding."""

    def __init__(self, tokenizer, cached: int, folds: bool = False) -> None:  # noqa: ANN001
        super().__init__()
        self.folds = folds
        self.whole, self.model, self.cached, self.older = tokenizer.encode, tokenizer.model.tokenize, cached, {}
        self.alphabet = byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.cached:
            self.older = dict(self)
            self.clear()
        known = self.older.get(piece)
        if known is None:
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                # one word of the pre-tokenizer: the model takes it in its own alphabet, where ASCII letters stay and a blank is U+0120
                word = piece.lower() if self.folds else piece
                own = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
                known = array("i", [t.id for t in self.model(own)]).tobytes()
            else:
                known = array("i", self.whole(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = known
        return known

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Encoder:
    """A tokenizers file with a bounded cache of encoded pieces; one in each Python worker."""

    def __init__(self, path: str, cached: int | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        kind = type(self.t.pre_tokenizer).__name__
        self.pieces = BLANKS_COUNT if kind == "ByteLevel" else BLANKS_DROP
        self.drop = str(self.t.normalizer) == FOLDS and str(self.t.pre_tokenizer) == DROPS
        # cut by columns, pieces cost so little that a small cache takes no longer than a large one did before
        cached = cached or (100_000 if self.drop else 400_000)
        self.cached = cached
        # pieces of letters are learnt from texts of many, one after another, with a token between that none of them has
        self.between = "\n" if kind == "ByteLevel" else " | "
        mark = self.t.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # then the model can be asked for a word by itself
        plain = kind == "ByteLevel" and self.t.normalizer is None and not self.t.pre_tokenizer.add_prefix_space
        self.direct = Pieces(self.t, cached, self.drop) if plain or self.drop else None
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.places: dict[str, bytes] = {}
        self.table: list[str] | None = None

    def learn(self, new: set[str]) -> None:
        """Put pieces into the cache, from the last full one where it has them."""
        if len(self.ids) + len(new) > self.cached:
            self.ids, self.older = {}, self.ids if len(self.ids) <= self.cached else {}
        ids, older = self.ids, self.older
        todo = []
        for piece in new:
            if (known := older.get(piece)) is None:
                todo.append(piece)
            else:
                ids[piece] = known
        words = [p for p in todo if p.isalpha() or (p[0] == " " and p[1:].isalpha())] if self.mark is not None else []
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            got = np.array(self.t.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, "<i4")
            ends = np.flatnonzero(got == self.mark)
            if len(ends) == len(some) - 1:
                raw, last = got.tobytes(), 0
                for piece, end in zip(some, [*ends.tolist(), len(got)], strict=True):
                    ids[piece] = raw[4 * last : 4 * end]
                    last = end + 1
        rest = [p for p in todo if p not in ids]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for piece, e in zip(some, self.t.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids[piece] = array("i", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        whole = self.t.encode
        if self.direct is not None:
            out = [b""] * len(texts)
            usual = []
            for k, x in enumerate(texts):
                if unusual(x):
                    out[k] = np.array(whole(x, add_special_tokens=False).ids, "<i4").tobytes()
                elif x:
                    usual.append(k)
            for k, ids in zip(usual, self.by_columns([texts[k] for k in usual]), strict=True):
                out[k] = ids
            return out
        for at in range(0, len(texts), 64):
            some = texts[at : at + 64]
            cut = [None if UNUSUAL.search(x) else self.pieces.findall(x) for x in some]
            every = set().union(*(c for c in cut if c is not None))
            new = every.difference(self.ids)
            if new:
                # where the cache starts anew, all pieces of these texts are needed
                self.learn(every if len(self.ids) + len(new) > self.cached else new)
            known = self.ids.__getitem__
            for x, c in zip(some, cut, strict=True):
                out.append(np.array(whole(x, add_special_tokens=False).ids, "<i4").tobytes() if c is None else b"".join(map(known, c)))
        return out

    def by_columns(self, texts: list[str]) -> list[bytes]:
        """The ids of usual texts, none of them empty: each distinct piece is looked up once, the rest is done by columns."""
        if not texts:
            return []
        raw = [x.encode() for x in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        begin = boundaries(data, starts[:-1], self.drop)
        of = np.searchsorted(begin, starts)  # each text's first piece
        if self.drop:
            white = WHITE[data]
            joined, begin = data[~white].tobytes(), begin - np.cumsum(white)[begin]
        coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(joined))), pa.py_buffer(joined)).dictionary_encode()
        code = coded.indices.to_numpy()
        table = list(map(self.direct.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, table), np.int64, len(table)) >> 2
        flat = np.frombuffer(b"".join(table), "<i4")
        each = size[code]
        upto = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat((np.cumsum(size) - size)[code] - upto[:-1], each)
        at += np.arange(len(at))
        ids, bounds = flat[at].tobytes(), (4 * upto[of]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def forget(self) -> None:
        """Free the pieces: Spark keeps a worker for other stages."""
        self.ids, self.older, self.places = {}, {}, {}
        if self.direct is not None:
            self.direct.forget()
        settle()

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.t.decoder is None:  # then it joins the tokens with blanks
            if self.table is None:
                n = self.t.get_vocab_size(with_added_tokens=True)
                self.table = [self.t.id_to_token(i) or "" for i in range(n)]
            return " ".join(map(self.table.__getitem__, ids.tolist()))
        return self.t.decode(ids.tolist(), skip_special_tokens=False)

    def spans(self, text: str) -> Spans:
        if UNUSUAL.search(text):
            e = self.t.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            return Spans(np.array(e.ids, dtype="<i4"), at[:, 0], at[:, 1])
        found = [(m.start(), m.group()) for m in self.pieces.finditer(text)]
        new = {p for _, p in found if p not in self.places}
        if len(self.places) + len(new) > self.cached:
            self.places.clear()
            new = {p for _, p in found}
        todo = list(new)
        for piece, e in zip(todo, self.t.encode_batch(todo, add_special_tokens=False), strict=True):
            self.places[piece] = np.array([(i, *x) for i, x in zip(e.ids, e.offsets, strict=True)], "<i4").tobytes()
        mine = [self.places[p] for _, p in found]
        got = np.frombuffer(b"".join(mine), "<i4").reshape(-1, 3)
        base = np.repeat(np.array([s for s, _ in found], dtype=np.int64), np.array([len(x) // 12 for x in mine], dtype=np.int64))
        return Spans(got[:, 0].astype("<i4"), got[:, 1] + base, got[:, 2] + base)


WIDTHS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}


class Spans:
    """Tokens of a stretch of text with their places."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.ids, self.start, self.end = ids, start, end

    def shift(self, by: int) -> Spans:
        return Spans(self.ids, self.start + by, self.end + by)

    def cut(self, lo: int | None, hi: int | None) -> Spans:
        return Spans(self.ids[lo:hi], self.start[lo:hi], self.end[lo:hi])

    @staticmethod
    def chain(parts: list[Spans]) -> Spans:
        return Spans(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "start", "end")))


def pack(spans: Spans) -> list[bytes]:
    """Ids, steps from start to start and lengths, each in the narrowest integers that hold them, after their width."""
    out = []
    for x in (spans.ids, np.diff(spans.start, prepend=0), spans.end - spans.start):
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        width = 8 if low < 0 or high >= 1 << 32 else 1 if high < 1 << 8 else 2 if high < 1 << 16 else 4
        out.append(bytes([width]) + x.astype(WIDTHS[width]).tobytes())
    return out


def unpack(ids: bytes, steps: bytes, lengths: bytes) -> Spans:
    ids_, step, length = (np.frombuffer(x, WIDTHS[x[0]], offset=1).astype("<i8") for x in (ids, steps, lengths))
    start = np.cumsum(step)
    return Spans(ids_.astype("<i4"), start, start + length)


def _agree(one: Spans, two: Spans, run: int) -> list[tuple[int, int]]:
    """Places (in one, in two) where runs of so many tokens are equal in ids and places."""
    where = {(int(s), int(e), int(i)): k for k, (s, e, i) in enumerate(zip(two.start, two.end, two.ids, strict=True))}
    pairs = [(k, where.get((int(s), int(e), int(i)), -1)) for k, (s, e, i) in enumerate(zip(one.start, one.end, one.ids, strict=True))]
    found = []
    for k in range(len(pairs) - run + 1):
        j = pairs[k][1]
        if j >= 0 and all(pairs[k + x][1] == j + x for x in range(run)):
            found.append((k, j))
    return found


def join_sides(encoder: Encoder, text: str, left: Spans, right: Spans, lo: int, mid: int, hi: int, window: int = 64, run: int = 3) -> Spans:
    """The tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi], all places counted from the text's start."""
    w = window
    while True:
        a, b = max(lo, mid - w), min(hi, mid + w)
        if a == lo and b == hi:
            return encoder.spans(text[lo:hi]).shift(lo)
        mine = encoder.spans(text[a:b]).shift(a)
        l0 = int(np.searchsorted(left.start, a))
        r1 = int(np.searchsorted(right.end, b, side="right"))
        lefts = [(0, 0)] if a == lo else [(k + l0, j) for k, j in _agree(left.cut(l0, None), mine, run) if left.end[k + l0 + run - 1] <= mid - run]
        rights = [(r1, len(mine.ids))] if b == hi else [(k + run, j + run) for k, j in _agree(right.cut(0, r1), mine, run) if right.start[k] >= mid + run]
        if lefts and rights:
            # the left side up to its last agreed run, the window from there, the right side after its first one
            (lk, lj), (rk, rj) = lefts[-1], rights[0]
            if a == lo:
                lk, lj = 0, 0
            if lj <= rj:
                return Spans.chain([left.cut(0, lk), mine.cut(lj, rj), right.cut(rk, None)])
        w *= 2


def join_tree(encoder: Encoder, text: str, leaves: list[Spans], bounds: list[int]) -> Spans:
    """leaves[i] are the tokens of text[bounds[i]:bounds[i + 1]], with places in the text."""
    while len(leaves) > 1:
        merged, ends = [], [bounds[0]]
        for i in range(0, len(leaves), 2):
            if i + 1 == len(leaves):
                merged.append(leaves[i])
                ends.append(bounds[i + 1])
            else:
                merged.append(join_sides(encoder, text, leaves[i], leaves[i + 1], bounds[i], bounds[i + 1], bounds[i + 2]))
                ends.append(bounds[i + 2])
        leaves, bounds = merged, ends
    return leaves[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ints(parts: list[bytes]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")), type=pa.list_(pa.field("element", pa.int32())))


def _slices(batch: pa.RecordBatch, column: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few long texts don't meet in one."""
    size, start = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size > chars:
            yield batch.slice(start, k + 1 - start)
            size, start = 0, k + 1
    if start < batch.num_rows:
        yield batch.slice(start)


IDS, DECODED = "ids", "decoded"
#: Characters that a worker encodes at once, so also those of a batch that it gives back.
CHARS = 1_000_000


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = IDS, decoded: str | None = None, long_chars: int = 32_768, leaf_chars: int = 16_384) -> DataFrame:
    """Add ``ids`` (array<int>) and, if named, ``decoded`` (the text that these ids decode to).

    Null and empty texts have no ids and decode to ''. Repeated rows and equal texts have equal results; all other
    columns pass, and those named like the new ones are replaced.
    """
    kept_names = others(docs, ids, decoded)
    docs = docs.select(*[tick(c) for c in docs.columns if c in kept_names or c == text])
    extra = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    names = kept_names
    schema = T.StructType([docs.schema[c] for c in names] + list(extra))

    def finish(enc: Encoder, parts: list[bytes]) -> list[pa.Array]:
        out: list[pa.Array] = [_ints(parts)]
        if decoded:
            out.append(pa.array([enc.decode(np.frombuffer(p, dtype="<i4")) for p in parts], pa.string()))
        return out

    where, kept = docs.columns.index(text), [docs.columns.index(c) for c in names]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in _slices(whole, where, CHARS):
                parts = enc.encode([x or "" for x in batch.column(where).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + finish(enc, parts), names=schema.names)
        enc.forget()

    n = F.coalesce(F.length(text), F.lit(0))
    plain = docs.where(n <= long_chars).mapInArrow(short, schema)

    # Long texts: leaves are rows of their own; the key is unique in a run and made and used by the same stage.
    key, no = "__text", "__leaf"
    leaf = T.StructType([T.StructField(key, T.LongType()), T.StructField(no, T.LongType()), T.StructField("piece", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("steps", T.BinaryType()), T.StructField("lengths", T.BinaryType())])
    long = docs.where(n > long_chars).withColumn(key, F.monotonically_increasing_id())
    cut = f"transform(sequence(0, cast(({{n}} - 1) div {leaf_chars} as int)), i -> substring({{t}}, i * {leaf_chars} + 1, {leaf_chars}))"
    rest = [c for c in names if c != text]
    packed = F.struct(*map(tick, rest)) if rest else F.lit(None).cast("int")
    leaves = long.select(key, packed.alias("rest"), F.posexplode(F.expr(cut.format(n=f"length({tick(text)})", t=tick(text)))).alias(no, "piece"))
    # only the first leaf carries the other columns
    leaves = leaves.withColumn("rest", F.when(F.col(no) == 0, F.col("rest"))).withColumn(no, F.col(no).cast("long"))
    leaves = leaves.repartition(F.col(key), F.col(no))
    coded = T.StructType([f for f in leaves.schema] + [leaf["ids"], leaf["steps"], leaf["lengths"]])
    at = leaves.columns.index("piece")

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in _slices(whole, at, CHARS):
                found = [pack(enc.spans(x)) for x in batch.column(at).to_pylist()]
                cols = [pa.array(x, pa.binary()) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(list(batch.columns) + cols, names=coded.names)
        enc.forget()

    out_key = T.StructType([f for f in leaves.schema if f.name == "rest"] + [T.StructField(text, T.StringType())] + list(extra))

    def join_leaves(table: pa.Table) -> pa.Table:
        enc = encoder(tokenizer)
        table = table.sort_by(no)
        pieces = table.column("piece").to_pylist()
        bounds = [0, *np.cumsum([len(p) for p in pieces]).tolist()]
        spans = [unpack(i, s, n).shift(b) for i, s, n, b in zip(*(table.column(k).to_pylist() for k in ("ids", "steps", "lengths")), bounds[:-1], strict=True)]
        whole = "".join(pieces)
        ids_ = join_tree(enc, whole, spans, bounds).ids.astype("<i4").tobytes()
        return pa.Table.from_arrays([table.column("rest").slice(0, 1), pa.array([whole], pa.string()), *finish(enc, [ids_])], names=out_key.names)

    tall = leaves.mapInArrow(encode_leaves, coded).groupBy(key).applyInArrow(join_leaves, out_key)
    unpacked = [F.col(text) if c == text else F.col("rest").getField(c).alias(c) for c in names]
    return plain.unionByName(tall.select(*unpacked, *[f.name for f in extra]))
