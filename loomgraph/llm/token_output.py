"""Token ids in a compressed binary form: a context-mixing range coder.

A segment begins with its order 0: the ids that occur in it and their shares of 65,536. Its ids are cut into blocks that are coded on their own:
a block starts with empty contexts and weights, carries a CRC-32 of its ids, and can be read with the segment's head alone. The distribution of an id
mixes three predictions: order 0, and the id that last followed the previous one or two ids in the block (orders 1 and 2), weighted by how
well these have done in the block so far; weights are renewed every RENEW ids. Every id of the segment always has a share, so none is escaped.
Many blocks are coded in step, one array lane each, in numpy.

A segment holds whole documents in order:
``CMRC``, documents, blocks and distinct ids (u32 each); doc ids (i64 each, the smallest value for null); ids per document (u32 each);
distinct ids ascending and their shares less one (u16 each); per block its ids, CRC-32 and words (u32 each); then the blocks' 16-bit words,
all little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

FILES = "part int, seq int, n_ids long, segment binary"
BLOCK, LANES, SEGMENT, RENEW = 1024, 8192, 1 << 20, 16
ROWS, TEXT = 1 << 14, 1 << 24  # documents and bytes of text that are tokenized and coded at once
READ = 6  # segments decoded at once
KEPT, CODED = 1 << 20, 1 << 12  # words whose ids a process remembers; words encoded at once
MAGIC, NULL_ID, END = b"CMRC", -(1 << 63), 2
_IDS, _SLOTS, _BITS = 1 << 16, 1024, 24  # ids; contexts of a lane; a distribution's total is 1 << _BITS
_MASK, _LOW = (1 << 48) - 1, 1 << 32
_MOST = np.array([[_IDS - (1 << 13)], [_IDS - (1 << 11)]])  # of 65,536: what orders 1 and 2 get at most, so that order 0 keeps one part in 256
_MARKS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"  # letters that have one form each, composed
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Order0:
    """Shares of segments' symbols; a symbol is the place of an id among the segment's distinct ids."""

    def __init__(self, shares: list[np.ndarray], owner: np.ndarray):
        self.shares, self.owner = shares, owner
        self.below = np.concatenate([x for s in shares for x in ([0], np.cumsum(s))])
        self.begins = np.cumsum([0] + [len(s) + 1 for s in shares[:-1]])

    def slots(self) -> np.ndarray:
        """The symbol at each of the 65,536 places of each segment."""
        out = np.zeros((len(self.shares), _IDS), np.uint16)
        for row, s in zip(out, self.shares, strict=True):
            row[:] = np.repeat(np.arange(len(s), dtype=np.uint16), s)
        return out.ravel()


def _shares(counts: np.ndarray) -> np.ndarray:
    """Shares of 65,536 by counts, at least 1 each."""
    out = 1 + counts * (_IDS - len(counts)) // counts.sum()
    out[np.argmax(counts)] += _IDS - out.sum()
    return out


class _Model:
    """The models of the blocks in step, a lane each. Symbol 0 stands for no guess; orders 1 and 2 never predict it."""

    def __init__(self, order0: _Order0, group: np.ndarray):
        lanes = len(group)
        self.below, self.above, self.own = order0.below, order0.below[1:], order0.begins[order0.owner[group]]
        self.rows, self.next = np.arange(lanes) * _SLOTS, [np.zeros(lanes * _SLOTS, np.uint16) for _ in (1, 2)]  # symbol that came last, by context
        self.hits, self.tries = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.int64)
        self.hit, self.seen = np.zeros((2, RENEW, lanes), bool), np.zeros((2, RENEW, lanes), bool)  # of the steps since weights were renewed

    def _renew(self) -> None:
        hit, tried = self.hit & self.seen, self.seen.copy()
        for x in (hit, tried):
            x[0] &= ~hit[1]  # order 1 is judged where order 2 was not right
        self.hits += hit.sum(axis=1)
        self.tries += tried.sum(axis=1)
        self.trust = np.minimum((self.hits + 0.2) / (self.tries + 1.0) * _IDS, _MOST).astype(np.int64)
        self.trust[1] <<= _BITS - 16

    def begin(self, t: int, one: np.ndarray, two: np.ndarray) -> None:
        """Step t after the symbols ``one`` and, before that, ``two``: guesses and weights."""
        n, k = len(one), t % RENEW
        if not k:
            self._renew()
        rows = self.rows[:n]
        self.at = (rows + (one & (_SLOTS - 1)), rows + ((one << 3 ^ two << 1 ^ two >> 8) & (_SLOTS - 1)))
        self.guess = [self.next[i].take(self.at[i]) for i in (0, 1)]
        seen, self.now = self.seen[:, k, :n], self.hit[:, k, :n]
        for i in (0, 1):
            np.greater(self.guess[i], 0, out=seen[i])
        second = self.trust[1, :n] * seen[1]
        self.rest = (1 << _BITS) - second
        first = self.rest * self.trust[0, :n]
        first >>= 16
        first *= seen[0]
        self.rest -= first
        self.weight = [first, second]

    def _scaled(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = table.take(at)
        out *= self.rest
        out >>= 16
        return out

    def span(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of each symbol in the mixed distribution."""
        at = self.own[: len(symbol)] + symbol
        start, width = self._scaled(self.below, at), self._scaled(self.above, at)
        width -= start
        for g, w, hit in zip(self.guess, self.weight, self.now, strict=True):
            np.equal(g, symbol, out=hit)
            start += w * (g < symbol)
            width += w * hit
        return start, width

    def find(self, x: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds x. Quotients are exact in doubles: below 2**17, of divisors up to 2**24."""
        (g, h), (v, w), own = self.guess, self.weight, self.own[: len(x)]
        a, b = np.minimum(g, h), np.maximum(g, h)
        both, wa = v + w, np.where(g > h, w, v)
        at_a, at_b = own + a, own + b
        past_a, past_b = x >= self._scaled(self.above, at_a) + wa, x >= self._scaled(self.above, at_b) + both
        free = x - wa * past_a
        free -= (both - wa) * past_b
        np.minimum(free, self.rest - 1, out=free)
        place = (((free + 1 << 16) - 1) / self.rest).astype(np.int64)
        place += first
        found = slots.take(place, mode="clip")
        found = np.where((x >= self._scaled(self.below, at_b) + wa) & ~past_b, b, found)
        return np.where((x >= self._scaled(self.below, at_a)) & ~past_a, a, found)

    def end(self, symbol: np.ndarray) -> None:
        for i in (0, 1):
            self.next[i][self.at[i]] = symbol


class _Writer:
    def __init__(self, lanes: int, size: int):
        self.begins = np.arange(lanes) * (2 * size + 4)
        self.words, self.at = np.zeros(lanes * (2 * size + 4), np.uint16), self.begins.copy()
        self.low, self.span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48)

    def _carry(self, low: np.ndarray) -> None:
        at = self.at[np.flatnonzero(low > _MASK)]
        low &= _MASK
        while len(at):  # a carry goes on where a word overflows to zero
            at = at - 1
            self.words[at] += np.uint16(1)
            at = at[self.words[at] == 0]

    def put(self, start: np.ndarray, width: np.ndarray) -> None:
        """Codes an interval in each of the first lanes."""
        n = len(start)
        r, at = self.span[:n] >> _BITS, self.at[:n]
        low, span = self.low[:n] + r * start, r * width
        self._carry(low)
        while (short := span < _LOW).any():
            self.words[at] = (low >> 32).astype(np.uint16)  # overwritten later in lanes that are not short
            at += short
            shift = short * 16
            low = low << shift & _MASK
            span <<= shift
        self.low[:n], self.span[:n] = low, span

    def close(self) -> list[np.ndarray]:
        """The words of each lane; behind them a reader sees zeros."""
        low = self.low + (_LOW - 1)
        self._carry(low)
        self.words[self.at] = (low >> 32).astype(np.uint16)
        return [self.words[a:b].copy() for a, b in zip(self.begins.tolist(), (self.at + 1).tolist(), strict=True)]


class _Reader:
    def __init__(self, blocks: list[np.ndarray]):
        width = max(map(len, blocks)) + 4
        words = np.zeros((len(blocks), width), np.uint16)
        for row, b in zip(words, blocks, strict=True):
            row[: len(b)] = b
        first = words[:, :3].astype(np.int64)
        self.value = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2]
        self.words, self.at, self.span = words.ravel(), np.arange(len(blocks)) * width + 3, np.full(len(blocks), 1 << 48)

    def target(self, n: int) -> np.ndarray:
        self.r = self.span[:n] >> _BITS
        return np.minimum((self.value[:n] / self.r).astype(np.int64), (1 << _BITS) - 1)  # less only in damaged blocks

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        n = len(start)
        value, span, at = self.value[:n] - self.r * start, self.r * width, self.at[:n]
        while (short := span < _LOW).any():
            shift = short * 16
            value = value << shift | self.words.take(at, mode="clip") * short
            at += short
            span <<= shift
        self.value[:n], self.span[:n] = value, span


def _lanes(sizes: np.ndarray):
    """(blocks, lanes in use at each step) of each group of blocks in step, longest first."""
    order = np.argsort(-sizes, kind="stable")
    for first in range(0, len(order), LANES):
        group = order[first : first + LANES]
        yield group, np.searchsorted(-sizes[group], -np.arange(sizes[group[0]])).tolist()


def encode_blocks(blocks: list[np.ndarray], order0: _Order0) -> list[np.ndarray]:
    """16-bit words of each block of symbols; what a block becomes depends on its own segment's order 0 only."""
    out, sizes = [np.zeros(0, np.uint16)] * len(blocks), np.array([len(b) for b in blocks])
    for group, active in _lanes(sizes):
        symbols = np.zeros((len(group), len(active) + 2), np.uint16)
        for row, i in zip(symbols, group.tolist(), strict=True):
            row[2 : 2 + sizes[i]] = blocks[i]
        symbols = np.ascontiguousarray(symbols.T)
        model, writer = _Model(order0, group), _Writer(len(group), len(active))
        for t, n in enumerate(active):
            model.begin(t, symbols[t + 1, :n], symbols[t, :n])
            writer.put(*model.span(symbols[t + 2, :n]))
            model.end(symbols[t + 2, :n])
        for i, words in zip(group.tolist(), writer.close(), strict=True):
            out[i] = words
    return out


def decode_blocks(blocks: list[np.ndarray], sizes: np.ndarray, order0: _Order0) -> list[np.ndarray]:
    out, slots = [np.zeros(0, np.uint16)] * len(blocks), order0.slots()
    for group, active in _lanes(sizes):
        model, reader, first = _Model(order0, group), _Reader([blocks[i] for i in group.tolist()]), order0.owner[group] * _IDS
        symbols = np.zeros((len(active) + 2, len(group)), np.uint16)
        for t, n in enumerate(active):
            model.begin(t, symbols[t + 1, :n], symbols[t, :n])
            symbols[t + 2, :n] = model.find(reader.target(n), slots, first[:n])
            reader.take(*model.span(symbols[t + 2, :n]))
            model.end(symbols[t + 2, :n])
        symbols = np.ascontiguousarray(symbols[2:].T)
        for row, i in zip(symbols, group.tolist(), strict=True):
            out[i] = row[: sizes[i]]
    return out


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> list[tuple[int, bytes]]:
    """(ids, segment) for documents in order; a segment ends with the document that brings it to SEGMENT ids."""
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(min(int(np.searchsorted(ends, before + SEGMENT)) + 1, len(sizes)))
    spans = [(a, b, int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    heads, blocks, sums, owner, symbol = [], [], [], [], np.zeros(_IDS, np.uint16)
    for k, (_, _, begin, end) in enumerate(spans):
        counts = np.bincount(ids[begin:end], minlength=_IDS)
        distinct = np.flatnonzero(counts)
        heads.append((distinct, _shares(counts[distinct]) if len(distinct) else distinct))
        symbol[distinct] = np.arange(len(distinct))
        symbols = symbol[ids[begin:end]]
        for p in range(0, end - begin, BLOCK):
            blocks.append(symbols[p : p + BLOCK])
            sums.append(zlib.crc32(ids[begin + p : min(begin + p + BLOCK, end)].astype("<u4").tobytes()))
            owner.append(k)
    coded = encode_blocks(blocks, _Order0([s for _, s in heads], np.array(owner, np.int64))) if blocks else []
    k, out = 0, []
    for (a, b, begin, end), (distinct, shares) in zip(spans, heads, strict=True):
        n = -(-(end - begin) // BLOCK)
        head = MAGIC + struct.pack("<III", b - a, n, len(distinct)) + doc_ids[a:b].astype("<i8").tobytes() + sizes[a:b].astype("<u4").tobytes()
        table = b"".join(struct.pack("<III", len(x), c, len(w)) for x, c, w in zip(blocks[k : k + n], sums[k : k + n], coded[k : k + n], strict=True))
        body = b"".join(w.astype("<u2").tobytes() for w in coded[k : k + n])
        out.append((end - begin, head + distinct.astype("<u2").tobytes() + (shares - 1).astype("<u2").tobytes() + table + body))
        k += n
    return out


def unpack(segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, ids) of each segment; a damaged block raises ValueError."""
    blocks, sizes, sums, owner, heads, shares = [], [], [], [], [], []
    for k, s in enumerate(segments):
        if s[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        docs, n, m = struct.unpack_from("<III", s, 4)
        at = 16 + 12 * docs
        distinct, share = np.frombuffer(s, "<u2", m, at), np.frombuffer(s, "<u2", m, at + 2 * m).astype(np.int64) + 1
        table = np.frombuffer(s, "<u4", 3 * n, at + 4 * m).reshape(n, 3).astype(np.int64)
        if n and share.sum() != _IDS:
            raise ValueError("a segment's shares are damaged")
        at += 4 * m + 12 * n
        for size, crc, words in table.tolist():
            blocks.append(np.frombuffer(s, "<u2", words, at))
            sizes.append(size)
            sums.append(crc)
            owner.append(len(shares))
            at += 2 * words
        if n:
            shares.append(share)
        heads.append((np.frombuffer(s, "<i8", docs, 16), np.frombuffer(s, "<u4", docs, 16 + 8 * docs).astype(np.int64), distinct, n))
    coded = decode_blocks(blocks, np.array(sizes, np.int64), _Order0(shares, np.array(owner, np.int64))) if blocks else []
    out, k = [], 0
    for doc_ids, counts, distinct, n in heads:
        parts = [distinct[x] for x in coded[k : k + n]]
        for i, x in enumerate(parts):
            if zlib.crc32(x.astype("<u4").tobytes()) != sums[k + i]:
                raise ValueError(f"block {k + i} is damaged")
        out.append((doc_ids, counts, np.concatenate(parts) if n else np.zeros(0, np.uint16)))
        k += n
    return out


def splits_words(tokenizer) -> bool:
    """Whether a piece of letters and marks behind them has the ids of the lower-case letters and then those of the marks, by the tokenizer's
    own rules, and every word's last id is told by a suffix: known of one form of tokenizer, false of all others."""
    rules = json.loads(tokenizer.to_str())
    normal, split = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    steps = [s.get("type") for s in normal.get("normalizers", [])], [s.get("type") for s in split.get("pretokenizers", [])]
    if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or rules["model"].get("end_of_word_suffix") != "</w>":
        return False
    first, second = split["pretokenizers"]
    if normal["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} or second["add_prefix_space"] or second["use_regex"]:
        return False
    if first != {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}:
        return False
    added = [t["content"] for t in rules["added_tokens"]]  # none may lie within letters, marks, or letters with marks behind them
    return all(t[:1] in _MARKS and any(c.isalpha() for c in t) for t in added if t) and all(added)


def _tails(whole: pa.Array, begin: pa.Array) -> pa.Array:
    """What follows ``begin`` in each of ``whole``, both without nulls and offsets."""
    sizes = pc.binary_length(whole).to_numpy() - pc.binary_length(begin).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends):
        return pa.array([], pa.string())
    last = np.frombuffer(whole.buffers()[1], np.int32)[1 : len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[np.repeat(last - ends, sizes) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(whole), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))


class Pieces:
    """Ids of pieces of text; those of some KEPT words are remembered, then all are forgotten and gathered anew."""

    def __init__(self, tokenizer):
        self.splits, self.ends = splits_words(tokenizer), np.zeros(_IDS, bool)
        if self.splits:
            self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.use(tokenizer)
        self._forget()

    def use(self, tokenizer) -> None:
        """Takes the tokenizer for what is not known yet; with None, none is held."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = self.plain = tokenizer
        if tokenizer and self.splits:  # for words that are in lower case and composed already
            self.plain = Tokenizer(tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.lengths, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per piece, ids)."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(map(len, coded), np.int32, len(coded)), np.array([x for ids in coded for x in ids], np.uint16)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, of words of lower-case letters, which are encoded as one text."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            return self._each(words)
        return np.diff(ends, prepend=-1).astype(np.int32), ids

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece in ``known``."""
        dealt = pieces.dictionary_encode()
        found = pc.index_in(dealt.dictionary, value_set=self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            lengths, flat = [self.lengths], [self.flat]
            missing, new = np.flatnonzero(at < 0), dealt.dictionary.filter(found.is_null())
            word = pc.match_substring_regex(new, _WORD).to_numpy(zero_copy_only=False) & self.splits
            for chosen, code in ((word, self._words), (~word, self._each)):
                names = new.filter(pa.array(chosen))
                at[missing[chosen]] = len(self.known) + np.arange(len(names))
                self.known = pa.concat_arrays([self.known, names])
                for k in range(0, len(names), CODED):
                    made = code(names[k : k + CODED].to_pylist())
                    lengths.append(made[0])
                    flat.append(made[1])
            self.lengths, self.flat = np.concatenate(lengths), np.concatenate(flat)
        return at[dealt.indices.to_numpy()]

    def look_up(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of each piece."""
        if len(self.known) > KEPT:
            self._forget()
        n = len(pieces)
        cores = pc.utf8_rtrim(pieces, _MARKS)
        word = pc.match_substring_regex(cores, _WORD).to_numpy(zero_copy_only=False) & self.splits
        cut = np.flatnonzero(word & (pc.binary_length(cores).to_numpy() < pc.binary_length(pieces).to_numpy()))
        words, others = np.flatnonzero(word), np.flatnonzero(~word)
        tails = _tails(pieces.take(pa.array(cut)), cores.take(pa.array(cut)))
        at = self._places(pa.concat_arrays([pc.utf8_lower(cores.take(pa.array(words))), pieces.take(pa.array(others)), tails]))
        first, parts = np.empty(n, np.int64), np.ones(n, np.int64)
        first[words], first[others] = at[: len(words)], at[len(words) : n]
        parts[cut] = 2
        known = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.lengths)), pa.int32()), pa.array(self.flat))
        found = known.take(pa.array(np.insert(first, cut + 1, at[n:])))
        return pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[np.append(0, np.cumsum(parts))]), found.values)


_KNOWN: dict[str, Pieces] = {}


def remembered(tokenizer_path: str) -> Pieces:
    """The words that this process knows of a tokenizer; the tasks of a Python worker share them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    if tokenizer_path in _KNOWN:
        _KNOWN[tokenizer_path].use(tokenizer)
    else:
        _KNOWN.clear()
        _KNOWN[tokenizer_path] = Pieces(tokenizer)
    return _KNOWN[tokenizer_path]


def token_ids(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, ids) of whole texts with an end id each. No token of this tokenizer spans ASCII white space, which it drops:

    a text's ids are those of its pieces between white space, and a piece that occurs again need not be encoded again.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace((texts.fill_null("") if texts.null_count else texts).cast(pa.string()))
    pieces = split.flatten().dictionary_encode()
    lists = known.look_up(pieces.dictionary)
    lists = pa.concat_arrays([lists, pa.array([[END]], lists.type)])
    ends = np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
    found = lists.take(pa.array(np.insert(pieces.indices.to_numpy(), ends, len(lists) - 1)))
    bounds = found.offsets.to_numpy()[np.append(0, ends + np.arange(1, len(ends) + 1))]
    return np.diff(bounds).astype(np.int64), found.flatten().to_numpy()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, partitions: int) -> None:
    """Writes segments of ``docs(doc_id, text)`` in ascending doc_id order to Parquet files with columns part, seq, n_ids, segment.

    Null text is empty and has the end id only. Rows with null doc_id come first; rows of equal doc_id follow in the order of a hash of
    their text. Very long texts are one document of one segment. An empty table gives files without rows. The smallest 64-bit doc_id stands for
    null in the format and comes back as null. A tokenizer with ids of 65,536 or more, or one whose ids depend on what lies beyond white
    space, is refused.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    if tokenizer.get_vocab_size() > _IDS:
        raise ValueError(f"{tokenizer_path}: ids of {_IDS} and more cannot be written")
    if any(ids(f"{a}{s}{b}") != ids(a) + ids(b) for a, b in (("Word", "word."), ("don't", "1 2"), ("É!", "été")) for s in (" ", "  ", "\n", "\t \r\n")):
        raise ValueError(f"{tokenizer_path}: its ids depend on white space")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        known, part, seq = remembered(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in slices(batches, 1, ROWS, TEXT):
            sizes, ids = token_ids(b.column(1), known)
            made = pack(b.column(0).fill_null(NULL_ID).to_numpy(), sizes, ids)
            pa.default_memory_pool().release_unused()  # a worker that waits should not hold what it no longer needs
            for n, segment in made:
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([segment], pa.binary())], names=["part", "seq", "n_ids", "segment"])
                seq += 1
        known.use(None)  # a worker that waits holds words only

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # rows that repeat a row may be cut apart; their order makes no difference
    dealt = rows.repartitionByRange(partitions, F.asc_nulls_first("doc_id"), "h", "copy").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")
    dealt.select("doc_id", "text").mapInArrow(run, FILES).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in files that ``write_tokens`` has written."""
    files = spark.read.schema(FILES).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(before, "part").select("part", "seq", (F.col("inside") + F.col("ahead")).alias("first"))

    def run(batches):
        for b in (b.slice(k, READ) for b in batches for k in range(0, len(b), READ)):
            for k, (doc_ids, counts, ids) in enumerate(unpack(b.column(1).to_pylist())):
                raw, ends = ids.astype("<u4"), np.cumsum(counts)
                crc = [zlib.crc32(raw[e - c : e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(b.column(0)[k].as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["part", "seq"]).select("first", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the token files of ``docs`` below the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'tokens').root}/files"
    write_tokens(docs, path, tokenizer_path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_tokens(spark, path)
