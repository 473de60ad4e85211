"""BPE encoding and decoding with a tokenization automaton.

States stand for the token read last, arcs are labelled with tokens, and a path spells a correct tokenization. The
automaton starts with one state per symbol and every arc; each merge (u, v) of the list, in order, adds one gadget:

* a state uv appears whose outgoing arcs are those of v at that moment;
* the arc u -> v goes away, since u before v is always merged;
* every state with an arc labelled u gets an arc labelled uv.

So what a gadget takes away is inherited by the states and labels that later gadgets derive from u and v. With states
numbered by right parts and labels by left parts, the heirs of u and of v are each one range of numbers, and the
compiled table holds, for each state, the ranges of labels it has no arc for. A second table reads symbols: a trie of
all tokens with links to the longest suffix that is a token.

A word is encoded from left to right. Every prefix has one correct tokenization, hence one state: the longest token
that ends there for which the state before it has an arc. Two array lookups decide each; all distinct words of a block
take a step together. Read from the last state back, the arcs spell the word; decoding emits their labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _POWERS, byte_codes, mix64, text_blocks

WORD_END = "</w>"
#: Fixed value: the code points of Unicode's white space.
SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters of a block, about: its distinct words are encoded together. A longer text is cut at white space.
BLOCK_CHARS = 1 << 19
#: Longer words, in bytes, are encoded one by one.
LONG = 256
GAP, LETTER, NUMBER, OTHER = range(4)
_U = np.uint64
#: Marks the last symbol of a word.
_LAST = 256
_CUT = regex.compile("[" + "".join(map(chr, SPACE)) + "]")


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _heirs(part: list[int], born: list[int]) -> tuple[list[int], list[int], list[list[int]], list[list[int]]]:
    """Number tokens so that those derived from one come just before it, the earliest first: the number of each, the
    first number below it, the tokens derived from it directly and when each was born."""
    size = len(born)
    derived: list[list[int]] = [[] for _ in range(size)]
    for token in sorted((t for t in range(size) if born[t] >= 0), key=born.__getitem__):
        derived[part[token]].append(token)
    number, first, count = [0] * size, [0] * size, 0
    for symbol in (t for t in range(size) if born[t] < 0):
        path = [(symbol, iter(derived[symbol]))]
        first[symbol] = count
        while path:
            token, rest = path[-1]
            below = next(rest, None)
            if below is None:
                number[token] = count
                count += 1
                path.pop()
            else:
                first[below] = count
                path.append((below, iter(derived[below])))
    return number, first, derived, [[born[t] for t in tokens] for tokens in derived]


class MergeAutomaton:
    """The automaton of a vocabulary and its merge list, compiled to arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        size = max(vocab.values()) + 1
        self.labels = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.ranks: dict[tuple[int, int], int] = {}
        sound = [True] * size
        for rank, (u, v) in enumerate((vocab[u], vocab[v]) for u, v in merges):
            uv = vocab[self.labels[u] + self.labels[v]]
            # A token that earlier merges never let arise is no tokenization of its own string.
            sound[uv] = sound[u] and sound[v] and not self.taken_away(u, v, rank)
            self.born[uv], self.left[uv], self.right[uv] = rank, u, v
            self.ranks.setdefault((u, v), rank)
        self._compile_arcs()
        self._compile_symbols([t for t in vocab.values() if sound[t]])

    def taken_away(self, state: int, label: int, before: int) -> bool:
        """Whether a gadget with a rank below ``before`` has taken the arc away, itself or for a part of its ends. What
        the compiled table must say, from the definition."""
        states, labels = [(state, before)], [(label, before)]
        while self.born[token := states[-1][0]] >= 0:
            states.append((self.right[token], self.born[token]))
        while self.born[token := labels[-1][0]] >= 0:
            labels.append((self.left[token], self.born[token] + 1))
        return any((rank := self.ranks.get((s, t))) is not None and rank < min(by_s, by_t) for s, by_s in states for t, by_t in labels)

    def _compile_arcs(self) -> None:
        """One range of labels for each gadget and each state it acts on; those of a state are then united."""
        size = len(self.born)
        states, first_s, derived_s, born_s = _heirs(self.right, self.born)
        labels, first_l, derived_l, born_l = _heirs(self.left, self.born)
        ranges = np.empty((len(self.ranks), 4), np.int64)
        for at, ((u, v), rank) in enumerate(self.ranks.items()):
            # Heirs are the tokens derived later; a label is derived before its own gadget's arc goes.
            s, t = bisect_right(born_s[u], rank), bisect_left(born_l[v], rank)
            low_s = first_s[derived_s[u][s]] if s < len(derived_s[u]) else states[u]
            low_t = first_l[derived_l[v][t]] if t < len(derived_l[v]) else labels[v]
            ranges[at] = low_s, states[u], low_t, labels[v]
        count = ranges[:, 1] - ranges[:, 0] + 1
        state = np.repeat(ranges[:, 0], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        low, high = state * size + np.repeat(ranges[:, 2], count), state * size + np.repeat(ranges[:, 3], count)
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        heads = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(low) else np.zeros(0, np.int64)
        #: First and last (state, label) number of each range without arcs, in order.
        self.gone_from = np.concatenate([[-1], low[heads]])
        self.gone_to = np.concatenate([[-1], high[np.append(heads[1:], len(low)) - 1] if len(heads) else heads])
        self.state_base = np.array(states, np.int64) * size
        self.label_number = np.array(labels, np.int64)

    def _compile_symbols(self, tokens: list[int]) -> None:
        """Trie of the tokens' symbols; node 0 is its root."""
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.arcs_of: dict[int, int] = {}
        token_at, self.length = [-1], np.zeros(len(self.labels), np.int64)
        for token in tokens:
            label = self.labels[token]
            body = label.removesuffix(WORD_END)
            if not body or any(c not in bytes_of for c in body):
                continue
            symbols = [bytes_of[c] for c in body]
            if body != label:
                symbols[-1] |= _LAST
            node = 0
            for symbol in symbols:
                key = node << 9 | symbol
                if key not in self.arcs_of:
                    self.arcs_of[key] = len(token_at)
                    token_at.append(-1)
                node = self.arcs_of[key]
            token_at[node] = token
            self.length[token] = len(symbols)
        below: list[list[tuple[int, int]]] = [[] for _ in token_at]
        for key, node in self.arcs_of.items():
            below[key >> 9].append((key & 511, node))
        back, chain, queue = [0] * len(token_at), [-1] * len(token_at), deque([0])
        while queue:
            at = queue.popleft()
            for symbol, node in below[at]:
                other = back[at]
                while at and other and (other << 9 | symbol) not in self.arcs_of:
                    other = back[other]
                back[node] = self.arcs_of.get(other << 9 | symbol, 0) if at else 0
                chain[node] = back[node] if token_at[back[node]] >= 0 else chain[back[node]]
                queue.append(node)
        keys = np.array(sorted(self.arcs_of), np.int64)
        self.node_keys, self.node_to = np.append(keys, 1 << 62), np.array([self.arcs_of[k] for k in keys.tolist()] + [0], np.int64)
        #: Where a node without an arc for a symbol goes on, its token, and the nearest node for a shorter token.
        self.back, self.token_at, self.chain = np.array(back), np.array(token_at), np.array(chain)
        del self.arcs_of

    def __getstate__(self) -> dict:
        """What tasks need: the compiled arrays and the labels."""
        return {k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray) or k == "labels"}

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        at = self.state_base[state] + self.label_number[label]
        return self.gone_to[np.searchsorted(self.gone_from, at, "right") - 1] < at

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node of the longest suffix read so far."""
        out = np.zeros_like(node)
        rest = np.arange(len(node))
        while len(rest):
            key = node << 9 | symbol
            at = np.searchsorted(self.node_keys, key)
            hit = self.node_keys[at] == key
            out[rest[hit]] = self.node_to[at[hit]]
            more = ~hit & (node > 0)
            rest, node, symbol = rest[more], self.back[node[more]], symbol[more]
        return out

    def walk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words, given by their bytes: ids of one word after the other, and how many each has."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        state = np.empty(len(data), np.int64)
        node = np.zeros(len(size), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            going = int(np.searchsorted(-size, -i, "left"))
            at = start[:going] + i
            symbol = data[at].astype(np.int64)
            symbol[size[:going] == i + 1] |= _LAST
            node[:going] = here = self._step(node[:going], symbol)
            here = np.where(self.token_at[here] >= 0, here, self.chain[here])
            begin = start[:going]
            while True:
                if here.min() < 0:
                    raise ValueError("a symbol of the word is not in the vocabulary")
                token = self.token_at[here]
                before = at - self.length[token]
                ok = before < begin
                inner = np.flatnonzero(~ok)
                ok[inner] = self.has_arc(state[before[inner]], token[inner])
                state[at[ok]] = token[ok]
                if ok.all():
                    break
                at, begin, here = at[~ok], begin[~ok], self.chain[here[~ok]]
        count, steps = np.zeros(len(size), np.int64), []
        live, at = np.arange(len(size)), start + size - 1
        live, at = live[size > 0], at[size > 0]
        while len(live):
            token = state[at]
            steps.append((live, token))
            count[live] += 1
            at = at - self.length[token]
            more = at >= start[live]
            live, at = live[more], at[more]
        counts = np.empty_like(count)
        counts[order] = count
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for back, (live, token) in enumerate(steps):
            ids[ends[order[live]] - 1 - back] = token
        return ids, counts

    def walk_one(self, word: bytes) -> list[int]:
        """Token ids of one long word, by the same tables."""
        if not hasattr(self, "_arcs"):
            self._arcs = dict(zip(self.node_keys.tolist(), self.node_to.tolist()))
            self._back, self._token, self._chain, self._length, self._base, self._number = (x.tolist() for x in (self.back, self.token_at, self.chain, self.length, self.state_base, self.label_number))
        arcs, gone_from, gone_to = self._arcs, memoryview(self.gone_from), memoryview(self.gone_to)
        state, node = np.empty(len(word), np.int32), 0
        states = memoryview(state)
        for i, symbol in enumerate(word):
            symbol |= _LAST * (i == len(word) - 1)
            while (to := arcs.get(node << 9 | symbol)) is None and node:
                node = self._back[node]
            node = here = to or 0
            while True:
                token = self._token[here]
                if token >= 0:
                    before = i - self._length[token]
                    if before < 0:
                        break
                    at = self._base[states[before]] + self._number[token]
                    if gone_to[bisect_right(gone_from, at) - 1] < at:
                        break
                here = self._chain[here]
                if here < 0:
                    raise ValueError("a symbol of the word is not in the vocabulary")
            states[i] = token
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(states[at])
            at -= self._length[states[at]]
        return ids[::-1]

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word of byte letters."""
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        return self.walk_one(bytes(bytes_of[c] for c in word))


def kinds_of_characters() -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for first, stop in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, stop)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for run in regex.finditer(pattern, every):
                kinds[first + run.start() : first + run.end()] = kind
    kinds[list(SPACE)] = GAP
    return kinds


def _word_bounds(chars: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 character of each word: runs of letters, single numbers, runs of others, and contractions,
    that is an apostrophe that begins a word and the letters s, t, m, d, re, ve or ll after it."""
    n = len(chars)
    begins = kind != GAP
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((chars[: n - 1] == ord("'")) & begins[: n - 1] & (kind[1:] == LETTER))
    if len(quote):
        one = chars[quote + 1]
        two = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        after = (quote + size)[quote + size < n]
        begins[after] = kind[after] != GAP
    ends = kind != GAP
    ends[:-1] &= begins[1:] | (kind[1:] == GAP)
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class TextEncoder:
    """Whole texts to ids and back, after a tokenizer file with lower-casing and word-end BPE."""

    def __init__(self, spec: str) -> None:
        config = json.loads(spec)
        model = config["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.names = self.automaton.labels + [""] * (1 + max(self.added.values(), default=0) - len(self.automaton.labels))
        for token, i in self.added.items():
            self.names[i] = token
        self.kinds = kinds_of_characters()

    def _pieces(self, text: str) -> Iterator[str | int]:
        """A text as normalised pieces without added tokens, none of them long, and the ids of added tokens."""
        if any(t in text for t in self.added):
            cut = "(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")"
            parts = regex.split(cut, text)
        else:
            parts = [text]
        for part in parts:
            if part in self.added:
                yield self.added[part]
                continue
            at = 0
            while at < len(part):
                gap = _CUT.search(part, at + BLOCK_CHARS) if len(part) > at + BLOCK_CHARS else None
                piece = part[at : gap.start() if gap else len(part)]
                at += len(piece)
                if not unicodedata.is_normalized("NFC", piece):
                    piece = unicodedata.normalize("NFC", piece)
                yield piece.replace("Σ", "σ").lower()

    def _block(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        joined = "\n".join(pieces)
        data = np.frombuffer(joined.encode(), np.uint8)
        starts = np.array([0, *accumulate(len(p) + 1 for p in pieces)])
        if len(data) == len(joined):
            begin, end = _word_bounds(data, self.kinds[data])
        else:
            chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            begin, end = _word_bounds(chars, self.kinds[chars])
        first = np.searchsorted(begin, starts)
        if len(data) != len(joined):
            width = np.ones(len(chars), np.int8) + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            begin, end = place[begin], place[end]
        ids, count, which = self._words(data, begin, end)
        # The ids of all words in text order.
        stop = np.concatenate([[0], np.cumsum(count[which])])
        base = np.cumsum(count) - count
        flat = ids[np.repeat(base[which] - stop[:-1], count[which]) + np.arange(stop[-1])]
        cut = stop[first]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words one after the other, how many each has, and which distinct word each word is."""
        up, down = _POWERS.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(byte_codes(41)[data] * up[: len(data)], out=sums[1:])
        size = end - begin
        key = mix64((sums[end] - sums[begin]) * down[begin] + size.astype(_U))
        del sums
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(size[one])])
        words = data[np.repeat(begin[one] - ends[:-1], size[one]) + np.arange(ends[-1])]
        # Hashes only propose that words are equal; their bytes decide.
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = (size == size[one][which]).all() and np.array_equal(data[np.repeat(begin, size) + inner], words[np.repeat(ends[:-1][which], size) + inner])
        if not same:
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(begin, end)])
            ends = np.array([0, *accumulate(map(len, known))])
            words = np.frombuffer(b"".join(known), np.uint8)
        long = np.diff(ends) > LONG
        bounds = np.concatenate([[0], np.cumsum(np.where(long, 0, np.diff(ends)))])
        if not long.any():
            ids, count = self.automaton.walk(words, ends)
        else:
            ids, count = self.automaton.walk(words[np.repeat(~long, np.diff(ends))], bounds)
            cut = np.cumsum(count) - count
            alone = [self.automaton.walk_one(words[ends[w] : ends[w + 1]].tobytes()) for w in np.flatnonzero(long)]
            ids = np.insert(ids, np.repeat(cut[long], [len(x) for x in alone]), np.concatenate([np.array(x, np.int32) for x in alone]))
            count[long] = [len(x) for x in alone]
        return ids, count, which

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        slots: list[np.ndarray] = []
        waiting, held, own = [], 0, [0]

        def settle() -> None:
            for at, ids in zip(waiting, self._block([slots[at] for at in waiting])):
                slots[at] = ids
            waiting.clear()

        for text in texts:
            for piece in self._pieces(text):
                slots.append(piece if isinstance(piece, str) else np.array([piece], np.int32))
                if isinstance(piece, str):
                    waiting.append(len(slots) - 1)
                    held += len(piece)
                    if held >= BLOCK_CHARS:
                        settle()
                        held = 0
            own.append(len(slots))
        if waiting:
            settle()
        none = np.zeros(0, np.int32)
        return [slots[a] if b - a == 1 else np.concatenate([none, *slots[a:b]]) for a, b in zip(own[:-1], own[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, separated by spaces."""
        return " ".join([self.names[i] for i in ids.tolist()])


def _encode_batches(encoder, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder.value
        for batch in batches:
            column = batch.column(1)
            for lo, hi, _, _ in text_blocks(column):
                counts, packed, digests, decoded = [], [], [], []
                for ids in coder.encode([text or "" for text in column.slice(lo, hi - lo).to_pylist()]):
                    raw = ids.astype("<u4").tobytes()
                    counts.append(len(ids))
                    packed.append(raw)
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(packed, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _broadcast(df: DataFrame, tokenizer_file: str):
    with open(tokenizer_file, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(TextEncoder(f.read()))


def encode(docs: DataFrame, tokenizer_file: str, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in
    UTF-8. Whole texts are encoded, long ones in pieces cut at white space; null counts as empty and gives no tokens. A
    null doc_id stays; repeated rows give repeated rows. Extra columns are ignored; an empty table gives an empty
    table. The compiled automaton, whose size the vocabulary fixes, is broadcast.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(_broadcast(docs, tokenizer_file), keep_ids), schema)


def _decode_batches(encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder.value
        for batch in batches:
            texts = [coder.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and the text that the ids (as encode keeps them) stand for; null ids give empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(_broadcast(encoded, tokenizer_file)), "doc_id long, text string")
