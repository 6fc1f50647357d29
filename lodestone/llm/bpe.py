"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's most frequent words, counted over all documents, are merged once on the driver and compiled
into a minimal acyclic automaton: suffixes are shared, and sums of outputs along a path number the words,
which index their ids. The file goes to the shared folder, Spark hands it to every executor, and workers
memory-map it. All distinct words of a piece of text walk the automaton together; a word it lacks is
merged exactly. ``lexicon_words`` bounds the file and what reaches the driver; it has no effect on results.

The tokenizer is the word-level kind of a ``tokenizers`` JSON file: NFC, white space to one space, lower
case; words by its split pattern; byte-level symbols with an end-of-word suffix. Special tokens written in
a text are matched first, as that library does. Texts of plain Latin-1 are split by byte tables; any other
text by the library's own normaliser and splitter, so Unicode rules agree.

Equal words of a piece of text are found by 64-bit hashes and confirmed by their bytes.

Defined cases: null text counts as empty and gives no ids and an empty decoded text; texts of any length are
encoded whole; repeated rows give repeated results; an empty table gives no rows; words equally frequent at the
lexicon's bound are all in or all out, without effect on ids; columns other than those asked for are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import drop, new_path, put_bytes, written
from lodestone.llm.text import pieces, span_hashes

NONE = np.int64(1) << 40
#: Words up to this many symbols are merged side by side, longer ones by a heap.
SIDE_BY_SIDE = 32
PIECE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and special tokens of a tokenizers JSON file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] is None or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or spec["decoder"] is not None:
            raise ValueError("not a word-level BPE file")
        self.path = path
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.names = names
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        text = [n.encode() + b" " for n in names]
        self.text_first = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = None

    @property
    def library(self):
        if self._library is None:
            import tokenizers

            self._library = tokenizers.Tokenizer.from_file(self.path)
        return self._library

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(rank of the merge of each pair, or NONE)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made[np.searchsorted(self.keys, a * self.size + b)]

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one word by a heap of (rank, place)."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._pairs
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = table[a, b][1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := table.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := table.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x is not None]

    @property
    def _pairs(self) -> dict:
        if not hasattr(self, "_pair_table"):
            a, b = self.keys // self.size, self.keys % self.size
            self._pair_table = {(x, y): (r, m) for x, y, r, m in zip(a.tolist(), b.tolist(), self.ranks.tolist(), self.made.tolist())}
        return self._pair_table

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of words given as byte spans: ids of word w are ids[first[w]:first[w + 1]]."""
        size = ends - starts
        counts = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SIDE_BY_SIDE)):
            at = np.flatnonzero((size > low) & (size <= high))
            if len(at):
                rows, n = self._side_by_side(data, starts[at], size[at], high)
                counts[at] = n
                parts.append((at, rows))
        long = {int(w): self.merge_long(data[starts[w] : ends[w]].tobytes()) for w in np.flatnonzero(size > SIDE_BY_SIDE)}
        for w, ids in long.items():
            counts[w] = len(ids)
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(first[-1]), np.uint32)
        for at, rows in parts:
            inside = np.arange(rows.shape[1]) < counts[at][:, None]
            out[(first[at][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        for w, ids in long.items():
            out[first[w] : first[w + 1]] = ids
        return out, first

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short words together: each round does the lowest-ranked, leftmost merge of every word."""
        columns = np.arange(width)
        bytes_ = data[np.minimum(starts[:, None] + columns, len(data) - 1)]
        ids = self.inner[bytes_]
        last = size - 1
        every = np.arange(len(size))
        ids[every, last] = self.final[bytes_[every, last]]
        size = size.copy()
        ranks = np.full(ids.shape, NONE)
        if width > 1:
            real = columns[:-1] < last[:, None]
            ranks[:, :-1][real] = self.rank(ids[:, :-1][real], ids[:, 1:][real])
        out = ids
        live = every
        while len(live):
            best = np.argmin(ranks, axis=1)
            go = ranks[np.arange(len(live)), best] < NONE
            if not go.all():
                done = live[~go]
                out[done] = ids[~go]
                live, ids, ranks, best = live[go], ids[go], ranks[go], best[go]
                if not len(live):
                    break
            if ids is out:
                ids = ids.copy()
            rows = np.arange(len(live))
            made = self.product(ids[rows, best], ids[rows, best + 1])
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NONE
            ids[rows, best] = made
            size[live] -= 1
            n = size[live]
            right = best + 1 < n
            ranks[rows, best] = NONE
            ranks[rows[right], best[right]] = self.rank(made[right], ids[rows[right], best[right] + 1])
            left = best > 0
            ranks[rows[left], best[left] - 1] = self.rank(ids[rows[left], best[left] - 1], made[left])
        return out, size


# --- splitting -------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _latin_classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, _OTHER, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _SPACE if b in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else _OTHER
        small = c.lower()
        if len(small) == 1 and ord(small) < 256:
            lower[b] = ord(small)
    return kind, lower


_KIND, _LOWER = _latin_classes()


def split_latin(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words of Latin-1 texts."""
    data = _LOWER[raw]
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    word = kind[starts] != _SPACE
    starts, ends = starts[word], ends[word]
    # contractions: a lone apostrophe takes s, t, m, d, re, ve or ll off the letters that follow
    lone = np.flatnonzero((data[starts] == 39) & (ends - starts == 1))
    lone = lone[lone + 1 < len(starts)]
    follows = (starts[lone + 1] == ends[lone]) & (kind[starts[lone + 1]] == _LETTER) & ~np.isin(starts[lone + 1], offsets)
    lone = lone[follows]
    if len(lone):
        a = data[starts[lone + 1]]
        long = ends[lone + 1] - starts[lone + 1] > 1
        b = np.where(long, data[np.minimum(starts[lone + 1] + 1, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        take = np.where(one, 1, np.where(two, 2, 0))
        ends = ends.copy()
        starts = starts.copy()
        ends[lone] += take
        starts[lone + 1] += take
        full = starts < ends
        starts, ends = starts[full], ends[full]
    return data, starts, ends


class Split:
    """Words and special tokens of a list of texts: byte spans into ``data``, ordered by text."""

    def __init__(self, texts: list[str | None], tok: Tokenizer):
        plain: list[bytes] = []
        odd: list[int] = []
        special = tok.special_re
        for i, t in enumerate(texts):
            try:
                b = (t or "").encode("latin-1")
                if b"<|" in b and special is not None and special.search(t):
                    raise ValueError
                plain.append(b)
            except ValueError:  # also what encode raises
                plain.append(b"")
                odd.append(i)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in plain])]).astype(np.int64)
        data, starts, ends = split_latin(np.frombuffer(b"".join(plain), np.uint8), offsets)
        rows = np.searchsorted(offsets, starts, "right") - 1
        # the same places in UTF-8
        place = np.concatenate([[0], np.cumsum(1 + (data >= 128))]).astype(np.int64)
        utf8 = data.tobytes().decode("latin-1").encode()
        starts, ends = place[starts], place[ends]
        codes = np.full(len(starts), -1, np.int64)
        if odd:
            more, s, e, r, c, at = [utf8], [], [], [], [], len(utf8)
            for i in odd:
                for word, code in self._library_words(texts[i], tok):
                    s.append(at)
                    at += len(word)
                    e.append(at)
                    r.append(i)
                    c.append(code)
                    more.append(word)
            utf8 = b"".join(more)
            starts, ends = np.concatenate([starts, np.array(s, np.int64)]), np.concatenate([ends, np.array(e, np.int64)])
            rows, codes = np.concatenate([rows, np.array(r, np.int64)]), np.concatenate([codes, np.array(c, np.int64)])
        self.data = np.frombuffer(utf8, np.uint8)
        self.hashes = span_hashes(self.data, starts, ends)
        order = np.argsort(rows, kind="stable") if odd else slice(None)
        self.starts, self.ends, self.rows, self.codes, self.hashes = starts[order], ends[order], rows[order], codes[order], self.hashes[order]
        self.first = np.searchsorted(self.rows, np.arange(len(texts) + 1))

    @staticmethod
    def _library_words(text: str, tok: Tokenizer) -> Iterator[tuple[bytes, int]]:
        """(bytes, -1) of words and (b"", id) of special tokens."""
        at = 0
        marks = [(m.start(), m.end(), tok.special[m[0]]) for m in tok.special_re.finditer(text)] if tok.special_re else []
        for start, end, code in [*marks, (len(text), len(text), -1)]:
            if start > at:
                normal = tok.library.normalizer.normalize_str(text[at:start])
                for piece, _ in tok.library.pre_tokenizer.pre_tokenize_str(normal):
                    yield bytes(tok.byte_of[c] for c in piece), -1
            if code >= 0:
                yield b"", code
            at = end


# --- the automaton ---------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, target, add, final) of the minimal acyclic automaton of sorted distinct words.

    keys are state * 256 + byte, ascending; state 0 starts. The sum of ``add`` along a word's path, plus
    nothing at its end, is the word's number in sorted order.
    """
    known: dict[tuple, int] = {}
    made: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    sizes: list[int] = []

    def settled(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in known:
            known[shape] = len(made)
            made.append(shape)
            sizes.append(int(node[0]) + sum(sizes[t] for _, t in node[1]))
        return known[shape]

    path: list[list] = [[False, []]]
    letters: list[int] = []
    for word in words:
        same = 0
        while same < min(len(word), len(letters)) and word[same] == letters[same]:
            same += 1
        while len(letters) > same:
            path[-2][1].append((letters.pop(), settled(path.pop())))
        for b in word[same:]:
            letters.append(b)
            path.append([False, []])
        path[-1][0] = True
    while letters:
        path[-2][1].append((letters.pop(), settled(path.pop())))
    top = settled(path[0])
    # the start becomes state 0
    name = lambda t: 0 if t == top else t + 1
    keys, target, add = [], [], []
    for state in sorted(range(len(made)), key=name):
        before = int(made[state][0])
        for b, t in made[state][1]:
            keys.append(name(state) * 256 + b)
            target.append(name(t))
            add.append(before)
            before += sizes[t]
    final = np.zeros(len(made) + 1, np.uint8)
    for state, (is_final, _) in enumerate(made):
        final[name(state)] = is_final
    return np.array(keys, np.int64), np.array(target, np.int32), np.array(add, np.int32), final


_PARTS = (("keys", np.int64), ("target", np.int32), ("add", np.int32), ("first", np.int64), ("ids", np.uint32), ("final", np.uint8))


class Lexicon:
    """The compiled automaton over a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            sizes = np.frombuffer(f.read(8 * len(_PARTS)), np.int64)
        at = 8 * len(_PARTS)
        for (name, kind), n in zip(_PARTS, sizes.tolist()):
            setattr(self, name, np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize

    @staticmethod
    def compiled(words: list[bytes], tok: Tokenizer) -> bytes:
        words = sorted(w for w in set(words) if w)
        keys, target, add, final = minimal_automaton(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        ids, first = tok.merge(np.frombuffer(b"".join(words), np.uint8), starts, ends) if words else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        held = {"keys": keys, "target": target, "add": add, "first": first, "ids": ids, "final": final}
        arrays = [np.ascontiguousarray(held[n], kind) for n, kind in _PARTS]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where the automaton does not accept it; all words take each step together."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        live, state, total = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = starts.copy()
        while len(live):
            stop = at == ends[live]
            if stop.any():
                good = stop & (self.final[state] == 1)
                out[live[good]] = total[good]
                live, state, total, at = live[~stop], state[~stop], total[~stop], at[~stop]
                if not len(live):
                    break
            key = state * 256 + data[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            live, place = live[there], place[there]
            state, total, at = self.target[place].astype(np.int64), total[there] + self.add[place], at[there] + 1
        return out


def gathered(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of values[first[w]:first[w + 1]] for w in which, and where each begins."""
    sizes = first[which + 1] - first[which]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(int(begins[-1])) + np.repeat(first[which] - begins[:-1], sizes)
    return values[index], begins


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(example, which): a span of each distinct word, and each span's number among them.

    Hashes find equal words and their bytes confirm it; should any differ, the bytes alone tell them apart.
    """
    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    again = np.flatnonzero(example[which] != np.arange(len(which)))
    size = (ends - starts)[again]
    same = bool(np.array_equal(size, (ends - starts)[example[which[again]]]))
    if same and len(again):
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = bool(np.array_equal(data[np.repeat(starts[again], size) + place], data[np.repeat(starts[example[which[again]]], size) + place]))
    if not same:
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(data[s:e].tobytes(), len(names)) for s, e in zip(starts, ends)], np.int64)
        _, example = np.unique(which, return_index=True)
    return example, which


def encode(texts: list[str | None], tok: Tokenizer, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): ids of text t are ids[first[t]:first[t + 1]]."""
    split = Split(texts, tok)
    plain = split.codes < 0
    starts, ends = split.starts[plain], split.ends[plain]
    example, which = distinct_words(split.data, starts, ends, split.hashes[plain])
    starts, ends = starts[example], ends[example]
    number = lexicon.numbers(split.data, starts, ends)
    seen = number >= 0
    known, known_first = gathered(lexicon.ids, lexicon.first, number[seen])
    new, new_first = tok.merge(split.data, starts[~seen], ends[~seen])
    # one table of the distinct words' ids, then one row for each special token
    codes = np.array(sorted(tok.special.values()), np.uint32)
    table = np.concatenate([known, new, codes]).astype(np.uint32)
    first = np.concatenate([known_first[:-1], len(known) + new_first[:-1], len(known) + len(new) + np.arange(len(codes) + 1)])
    rank = np.empty(len(example), np.int64)
    rank[seen] = np.arange(int(seen.sum()))
    rank[~seen] = int(seen.sum()) + np.arange(int((~seen).sum()))
    word = np.empty(len(split.rows), np.int64)
    word[plain] = rank[which]
    word[~plain] = len(example) + np.searchsorted(codes, split.codes[~plain])
    ids, begins = gathered(table, first, word)
    return ids, begins[split.first]


def decode(ids: np.ndarray, first: np.ndarray, tok: Tokenizer) -> list[bytes]:
    """Texts of ids: the tokens, spaces between."""
    text, begins = gathered(tok.text, tok.text_first, ids.astype(np.int64))
    at = begins[first].tolist()
    whole = text.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


_tokenizers: dict[str, Tokenizer] = {}
_lexicons: dict[str, Lexicon] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def _count(path: str, flush: int = 1 << 18):
    """Distinct words of a task and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, held = tokenizer(path), {}

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w for w, _ in held.values()], pa.binary()), pa.array([n for _, n in held.values()], pa.int64())], ["word", "n"])

        for batch in pieces(batches, "text", PIECE):
            split = Split(batch.column("text").to_pylist(), tok)
            plain = np.flatnonzero(split.codes < 0)
            hashes, example, counts = np.unique(split.hashes[plain], return_index=True, return_counts=True)
            whole = split.data.tobytes()
            for h, s, e, n in zip(hashes.tolist(), split.starts[plain][example].tolist(), split.ends[plain][example].tolist(), counts.tolist()):
                old = held.get(h)
                held[h] = (whole[s:e], n) if old is None else (old[0], old[1] + n)
            if len(held) >= flush:
                yield packed()
                held = {}
        if held:
            yield packed()

    return run


def frequent_words(docs: DataFrame, path: str, most: int) -> list[bytes]:
    """The most frequent words of all texts of docs(text), ``most`` at most.

    Counts are put into at most 512 classes by size; the largest classes that fit are taken whole, so what
    comes to the driver is bounded, whatever the number of partitions.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = written(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("size")), "lexicon-counts")
    left, least = most, None
    for row in sorted(ranked.groupBy("size").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["size"]):
        if row.words > left:
            break
        left, least = left - row.words, row["size"]
    words = [] if least is None else [bytes(r.word) for r in ranked.where(F.col("size") >= least).select("word").collect()]
    drop(ranked)
    return words


def publish(docs: DataFrame, path: str, lexicon_words: int) -> str:
    """Compile the lexicon, put it into the shared folder and give it to all executors; its name there."""
    spark = docs.sparkSession
    at = new_path(spark, "lexicon")
    put_bytes(spark, at, Lexicon.compiled(frequent_words(docs, path, lexicon_words), tokenizer(path)))
    spark.sparkContext.addFile(at)
    return at.rsplit("/", 1)[1]


def _encode(path: str, name: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        if name not in _lexicons:
            _lexicons.clear()
            _lexicons[name] = Lexicon(SparkFiles.get(name))
        for batch in pieces(batches, "text", PIECE):
            ids, first = encode(batch.column("text").to_pylist(), tok, _lexicons[name])
            raw, at = ids.astype("<u4").tobytes(), (first * 4).tolist()
            columns = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(np.diff(first)), pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array(decode(ids, first, tok), pa.binary()).cast(pa.string()))
                names.append("decoded")
            yield pa.record_batch(columns, names)

    return run


def encoded(docs: DataFrame, path: str, keep: list[str], lexicon_words: int = 1 << 16, decoded: bool = True) -> DataFrame:
    """(keep..., n_tokens, ids, decoded): ids are little-endian unsigned 32-bit integers, decoded their text."""
    name = publish(docs, path, lexicon_words)
    plain = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = "".join(f"`{c}` {plain.schema[c].dataType.simpleString()}, " for c in keep)
    return plain.mapInArrow(_encode(path, name, decoded), schema + "n_tokens long, ids binary" + (", decoded string" if decoded else ""))
