"""BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

Spark counts the words of all documents. The most frequent ones are merged once and compiled, in one task over a bounded list, into
a minimal acyclic automaton whose arcs carry numbers: their sum along a word is its rank among the words, which leads to its ids.
States with the same future are shared; arcs lie in a double array, so that a step is one look-up. The file goes to the folder
that all executors share; they map it into memory and walk it for all words of a batch side by side. Words that it lacks are
merged exactly by the model's ranks.

The tokenizer's file gives vocabulary, merge ranks, special tokens, normalizer and pre-tokenizer. Chunks between ASCII spaces (which
no token crosses in tokenizers that drop white space) of printable ASCII and Latin-1 letters are lower-cased and split by array
operations, if these agree with the library on a probe; other chunks go through the library's own normalizer and pre-tokenizer.
Decoding is the library's for a model without decoder: the ids' token strings joined by one space.

Defined cases: null and empty texts have no ids and decode to an empty text; a null doc_id stays null; repeated rows each
give a row; extra columns are ignored; an empty table gives an empty result. Of words that are equally frequent either all or none
are compiled, which changes no result. Texts have no length limit: long ones are worked off in segments that end at white space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MODEL = "word_bpe_49k.json"
#: At most so many words are compiled (about 8 MB), each seen at least LEAST times and of 2 to LONGEST letters.
LEXICON_WORDS, LEAST, LONGEST = 131_072, 3, 40
#: A worker keeps the ids of at most so many words that the lexicon lacks; it works on segments of about SEGMENT bytes.
REMEMBERED, SEGMENT = 100_000, 1 << 20

#: Byte-level BPE writes every byte as one character: printable ones as themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_CHARS = [_BYTE[b] for b in range(256)]

_SPACE, _LETTER, _DIGIT, _OTHER, _SLOW = range(5)
_CLASS = np.full(256, _SLOW, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LATIN_LEAD = 0xC3  # with the byte after it: U+00C0 to U+00FF
#: What may follow an apostrophe as one piece, from the split pattern of the tokenizer's file.
_CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


class Merger:
    """Exact merging of one pre-token: the adjacent pair of lowest rank (leftmost first) merges until none is left."""

    def __init__(self, spec: dict):
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""

    def tokens(self, word: str) -> list[str]:
        parts = list(word)
        parts[-1] += self.suffix
        return self._few(parts) if len(parts) <= 40 else self._many(parts)

    def ids(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.tokens(word)]

    def _few(self, parts: list[str]) -> list[str]:
        """Looks through all pairs for each merge."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = whole = parts[i] + parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], whole), none)
            if i < len(ranks):
                ranks[i] = get((whole, parts[i + 1]), none)
        return parts

    def _many(self, parts: list[str | None]) -> list[str]:
        """Keeps the pairs in a heap, so that a long word takes n log n steps."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts) and (pair := (parts[left], parts[right])) in self.rank:
                    heapq.heappush(heap, (self.rank[pair], left, *pair))
        return [p for p in parts if p is not None]


def _minimal(words: list[bytes]) -> tuple[list[tuple[bool, tuple]], int]:
    """States ``(final, ((label, target), ...))`` of the minimal automaton of sorted words, targets before their sources, and the root.

    Words come in order, so that a state is finished when the next word leaves it; a finished state is replaced by an equal one.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def finish(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, []]], b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            limit = min(len(word), len(last))
            while common < limit and word[common] == last[common]:
                common += 1
        while len(path) - 1 > common:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(node)))
        if word is None:
            break
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    return states, finish(path[0])


def _place(states: list[tuple[bool, tuple]]) -> tuple[list[int], int]:
    """A base for each state such that no two arcs have the same slot (base + label), and how many slots there are."""
    base, used, free, begin = [0] * len(states), bytearray(1024), 0, 0
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        labels = [label for label, _ in states[s][1]]
        if not labels:
            break
        free = used.find(0, free)  # slots before it are all taken
        at, tried = max(free, begin if len(labels) > 1 else 0, labels[0]), 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + 512 > len(used):
                used += bytearray(len(used))
                at = len(used) // 2 if at < 0 else at
                continue
            if all(not used[at - labels[0] + x] for x in labels):
                break
            at, tried = at + 1, tried + 1
        if tried > 64:
            begin = at  # the places before it are too full for several arcs
        base[s] = at - labels[0]
        for x in labels:
            used[base[s] + x] = 1
    return base, len(used)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton's file: header, then arrays of 32-bit numbers.

    Per state: base and whether a word ends there; per slot: owner, target and number of its arc; per word: where its ids begin; ids.
    """
    words = sorted(entries)
    states, root = _minimal(words)
    base, slots = _place(states)
    owner, target, number = (np.full(slots, v, np.int32) for v in (-1, 0, 0))
    below: list[int] = []  # words that end at or under a state
    for s, (final, arcs) in enumerate(states):
        skipped = int(final)
        for label, to in arcs:
            owner[base[s] + label], target[base[s] + label], number[base[s] + label] = s, to, skipped
            skipped += below[to]
        below.append(skipped)
    offsets = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = [i for w in words for i in entries[w]]
    head = struct.pack("<6I", len(states), slots, root, len(words), len(ids), max(map(len, words), default=0))
    parts = [base, [f for f, _ in states], owner, target, number, offsets, ids]
    return head + b"".join(np.asarray(p, np.int64).astype(np.uint32).tobytes() for p in parts)


class Lexicon:
    """A compiled automaton in a buffer or a file mapped into memory."""

    def __init__(self, buffer):
        n, slots, self.root, words, ids, self.longest = struct.unpack_from("<6I", buffer, 0)
        at, parts = 24, []
        for size in (n, n, slots, slots, slots, words + 1, ids):
            parts.append(np.frombuffer(buffer, np.uint32, size, at))
            at += 4 * size
        base, self.final, owner, target, number, self.offsets, self.ids = parts
        self.base, self.owner, self.target, self.number = (x.view(np.int32) for x in (base, owner, target, number))

    @classmethod
    def opened(cls, uri: str) -> Lexicon:
        """A file of a local path is mapped; of another file system it is read into anonymous mapped memory."""
        fs, path = C.filesystem(uri)
        if fs.type_name == "local":
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with fs.open_input_file(path) as f:
            memory = mmap.mmap(-1, f.size())
            memory.write(f.read())
        return cls(memory)

    def ranks(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rank of each word ``text[start : start + size]``, or -1. One step of all words at a time."""
        out = np.full(len(starts), -1, np.int64)
        left = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        at, size = starts[left], sizes[left]
        state, number = np.full(len(left), self.root, np.int32), np.zeros(len(left), np.int32)
        k = 0
        while len(left):
            slot = self.base[state] + text[at + k]
            going = self.owner[slot] == state
            k += 1
            if not going.all():
                left, at, size, number, slot = left[going], at[going], size[going], number[going], slot[going]
            state, number = self.target[slot], number + self.number[slot]
            ended = size == k
            if ended.any():
                words = ended & (self.final[state] > 0)
                out[left[words]] = number[words]
                more = ~ended
                left, at, size, number, state = left[more], at[more], size[more], number[more], state[more]
        return out

    def get(self, word: bytes) -> list[int] | None:
        rank = int(self.ranks(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0]) if word else -1
        return None if rank < 0 else self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges ``begin`` to ``begin + size``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Written:
    """A text for each id, for many ids at a time."""

    def __init__(self, texts: dict[int, str]):
        parts = [(" " + texts[i]).encode("utf-8", "surrogatepass") if i in texts else b"" for i in range(max(texts) + 1)]
        self.at = np.cumsum([0, *map(len, parts)])
        self.size, self.blob = np.diff(self.at), np.frombuffer(b"".join(parts), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts, each behind one space, and where each begins (and the last ends)."""
        sizes = self.size[ids]
        return self.blob[_ranges(self.at[ids], sizes)], np.concatenate(([0], np.cumsum(sizes)))


def pieces(raw: np.ndarray, fast: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes lower-cased, and start, size and slowness of each piece: a pre-token, or a whole chunk that only the library splits."""
    cls, low = _CLASS[raw], _LOWER[raw]
    if len(raw):
        high = np.flatnonzero(raw[:-1] == _LATIN_LEAD)
        if len(high):
            second = raw[high + 1]
            kind = np.where((second == 0x97) | (second == 0xB7), _OTHER, _LETTER)  # the two signs among the letters
            cls[high], cls[high + 1] = kind, kind
            capital = high[(second < 0x9F) & (second != 0x97)]
            low[capital + 1] += 32
    space = cls == _SPACE
    begin = np.empty(len(raw), bool)
    begin[:1] = True
    begin[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
    quote = np.flatnonzero((raw[:-1] == 39) & begin[:-1] & begin[1:] & (cls[1:] == _LETTER))
    for q in quote:  # an apostrophe alone before a letter
        for tail in _CONTRACTIONS:
            end = q + 1 + len(tail)
            if low[q + 1 : end].tobytes() == tail:
                begin[q + 1] = False
                if end < len(raw) and cls[end] == _LETTER:
                    begin[end] = True
                break
    begin &= ~space
    bad = (cls == _SLOW) if fast else ~space
    if len(raw) > 1:
        bad[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # special tokens begin with these two
    slow = np.zeros(len(raw), bool)
    if bad.any():
        first = np.empty(len(raw), bool)  # of each chunk, white space being chunks too
        first[:1] = True
        first[1:] = space[1:] != space[:-1]
        at = np.flatnonzero(first)
        chunk = np.cumsum(first) - 1
        slow = np.logical_or.reduceat(bad, at)[chunk]
        begin = np.where(slow, first & ~space, begin)
    edge = np.flatnonzero(begin | space)
    ends = np.append(edge[1:], len(raw))
    unit = begin[edge]
    starts = edge[unit]
    return low, starts, ends[unit] - starts, slow[starts]


class Encoder:
    """Texts to ids: pieces by array operations, the lexicon for all of them at once, exact merges for the rest."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok, self.merger = Tokenizer.from_file(path), Merger(spec)
        self.lexicon = lexicon or Lexicon(compile_lexicon({}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        if spec["decoder"] or spec["post_processor"] or not plain or self.pretokens("a b") != self.pretokens("a") + self.pretokens("b"):
            raise ValueError("only tokenizers that drop white space and have neither decoder nor post-processor")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in (spec["model"]["vocab"] | self.special).items()}
        self.ids_text, self.names_text = _Written({i: str(i) for i in names}), _Written(names)
        self.known: dict[tuple[bool, bytes], list[int]] = {}
        # the short way holds only if it agrees with the library on a text of all its characters
        probe = "".join(map(chr, [*range(33, 127), *range(0xC0, 0x100)])) + "I'll we're 42x 'Tis 'salt x'd"
        self.fast = all(s.startswith("<|") for s in self.special) and all(self.short(x) == self.pretokens(x) for x in (probe, probe[::-1], *probe))

    def pretokens(self, text: str) -> list[str]:
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def short(self, text: str) -> list[str]:
        low, starts, sizes, _ = pieces(np.frombuffer(text.encode(), np.uint8))
        return ["".join(_CHARS[b] for b in low[s : s + n].tolist()) for s, n in zip(starts, sizes, strict=True)]

    def merged(self, slow: bool, piece: bytes) -> list[int]:
        """The ids of a lower-cased pre-token, or of any run without ASCII spaces (special tokens, then the library's pre-tokens)."""
        if not slow:
            return self.merger.ids("".join([_CHARS[b] for b in piece]))
        out, text = [], piece.decode("utf-8", "surrogatepass")
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [i for w in self.pretokens(part) for i in self.merger.ids(w)]
        return out

    def ids(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece starts, how many ids it has, and all ids. ``raw``: bytes of texts apart by white space."""
        low, starts, sizes, slow = pieces(raw, self.fast)
        rank = self.lexicon.ranks(low, starts, np.where(slow, 0, sizes))
        hit = rank >= 0
        begin, many = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        begin[hit] = self.lexicon.offsets[rank[hit]]
        many[hit] = self.lexicon.offsets[rank[hit] + 1] - begin[hit]
        rest, at = [], len(self.lexicon.ids)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        lost = np.flatnonzero(~hit)
        whole, lower = raw.tobytes(), low.tobytes()
        counts = []
        for s, n, odd in zip(starts[lost].tolist(), sizes[lost].tolist(), slow[lost].tolist(), strict=True):
            key = (odd, (whole if odd else lower)[s : s + n])
            found = self.known.get(key)
            if found is None:
                found = self.merged(*key)
                if n <= 1000:
                    self.known[key] = found
            rest += found
            counts.append(len(found))
        many[lost] = counts
        begin[lost] = at + np.cumsum([0, *counts])[:-1]
        table = np.concatenate([self.lexicon.ids, np.array(rest, np.uint32)])
        return starts, many, table[_ranges(begin, many)]

    def encode(self, text: str) -> tuple[str, str, int]:
        """Ids and decoded text, each joined by spaces, and how many ids."""
        ids = self.ids(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[2]
        joined = [table.of(ids)[0].tobytes()[1:].decode("utf-8") for table in (self.ids_text, self.names_text)]
        return joined[0], joined[1], len(ids)

    def segments(self, texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
        """The texts' ids, segment by segment: which text has ids from where to where (long texts come in several segments), and the ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        doc, within = 0, 0  # the next text, and how many of its bytes are done
        while doc < len(texts):
            parts, owners, held = [], [], 0
            while doc < len(texts) and held < SEGMENT:
                begin, end = int(bounds[doc]) + within, int(bounds[doc + 1])
                stop = end
                if end - begin > SEGMENT:  # up to the next white space after a segment's length
                    stop = begin + SEGMENT
                    while stop < end:
                        gap = np.flatnonzero(_CLASS[data[stop : stop + SEGMENT]] == _SPACE)
                        if len(gap):
                            stop += int(gap[0])
                            break
                        stop = min(end, stop + SEGMENT)
                parts += [data[begin:stop], _GAP]
                owners.append((doc, held))
                held += stop - begin + 1
                doc, within = (doc + 1, 0) if stop == end else (doc, within + stop - begin)
            starts, many, ids = self.ids(np.concatenate(parts))
            edges = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(starts, [at for _, at in owners] + [held])]
            yield [(d, int(a), int(b)) for (d, _), a, b in zip(owners, edges, edges[1:], strict=False)], ids


_GAP = np.array([10], np.uint8)


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> DataFrame:
    """``w``: the most frequent runs of letters (lower-cased) of all documents, at most ``limit``.

    A histogram of the counts in eighths of a doubling (some hundred rows at any size) gives the least count that keeps the limit.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST) & F.char_length("w").between(2, LONGEST))
    counts = C.cut(counts.select("w", F.floor(8 * F.log2("n")).cast("int").alias("step")))
    steps = sorted((r.step, r.many) for r in counts.groupBy("step").agg(F.count("*").alias("many")).collect())
    total, least = 0, 1 << 20
    for step, many in reversed(steps):
        total += many
        if total > limit:
            break
        least = step
    return counts.filter(F.col("step") >= least).select("w")


def build_lexicon(words: list[str], path: str) -> bytes:
    """Compiles the pre-tokens of ``words`` with their ids."""
    make = Encoder(path)
    low, starts, sizes, slow = pieces(np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8), make.fast)
    whole = low.tobytes()
    found = {whole[s : s + n] for s, n in zip(starts[~slow].tolist(), sizes[~slow].tolist(), strict=True)}
    return compile_lexicon({p: make.merged(False, p) for p in found})


def write_lexicon(words: DataFrame, path: str) -> str:
    """Compiles the words (a bounded list) in one task and writes the file to the shared folder; its place."""
    spark = words.sparkSession
    folder = f"{C.shared_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    fs, root = C.filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = build_lexicon([w for b in batches for w in b.column("w").to_pylist()], path)
        name = f"{uuid.uuid4().hex}.bin"  # an attempt's own file: a repeated task disturbs nobody
        fs, root = C.filesystem(folder)
        with fs.open_output_stream(os.path.join(root, name), compression=None) as f:
            f.write(blob)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return f"{folder}/{words.repartition(1).mapInArrow(run, 'name string').first().name}"


_OPEN: dict[tuple[str, str], Encoder] = {}


def _opened(path: str, place: str) -> Encoder:
    """The worker's encoder, made once."""
    if (path, place) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, place] = Encoder(path, Lexicon.opened(place))
    return _OPEN[path, place]


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, with_values: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row; with values also ``ids`` and ``decoded``."""
    place = write_lexicon(frequent_words(docs, lexicon_words), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _opened(path, place)
        tables = (coder.ids_text, coder.names_text)
        for b in batches:
            n = [0] * len(b)
            shas = [[hashlib.sha256() for _ in range(len(b))] for _ in tables]
            values: list[list[int]] = [[] for _ in range(len(b) if with_values else 0)]
            decoded = [""] * len(b)
            for owners, ids in coder.segments(b.column("text")):
                for table, sha in zip(tables, shas, strict=True):
                    text, at = table.of(ids)
                    text = memoryview(text)
                    for doc, first, end in owners:
                        if end > first:
                            part = text[at[first] + (not n[doc]) : at[end]]  # no space before a text's first id
                            sha[doc].update(part)
                            if with_values and table is coder.names_text:
                                decoded[doc] += bytes(part).decode("utf-8")
                for doc, first, end in owners:
                    n[doc] += end - first
                    if with_values:
                        values[doc] += ids[first:end].tolist()
            out = [b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([s.hexdigest() for s in sha], pa.string()) for sha in shas)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_values:
                out += [pa.array(values, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.dtypes)["doc_id"]
    more = ", ids array<int>, decoded string" if with_values else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(C.table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
