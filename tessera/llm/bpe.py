"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

The merges are compiled one after another into an automaton over tokens. Every
token u has one state, the one reached by an arc labelled u. The gadget for the
merge (u, v) -> w does three things:

- every state with an arc u gets an arc w (w may follow whatever u may follow);
- the state of w starts with the arcs that the state of v has now;
- the arc v of the state of u goes (u then v is now always written w).

Where u equals v the arc goes before the arcs u are copied, else after: so
u u u is read as w u. In the end a token sequence is a path of the automaton
if and only if it is what applying the merges in order gives. The arcs are
kept as a bit table: one bit a state, one row for all tokens that may follow
the same states.

A word is encoded by dynamic programming over its symbols: for each end
position exactly one token both matches the text there and has an arc from
the state of the token before it. Decoding emits the labels of the arcs.

The merges are compiled once, in a task; what the tasks that encode get are the
tables: bits (equal rows kept once), a double array for the
symbols, and labels, some megabytes whatever the input.

Long words cost time in proportion to their length; nothing is cut. Encoded
words are kept in a cache of bounded size; of a full one those words stay that
were met again.
"""

from __future__ import annotations

import gc
import hashlib
import json
import pickle
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import release_memory

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words of more bytes are encoded one by one. Characters that are looked at together.
LONG, BLOCK = 48, 2_000_000
#: Letters and numbers that came after Unicode 16, which the tokenizers library does not take for such.
_LATER = regex.compile(
    "[\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959"
    "\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    "\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    "\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    "\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F]"
)
#: First and last capital of a range, step, and how far the small letters are: pairs of Unicode 16 and 17, which the library lower-cases.
_PAIRS = (
    (0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 1, 0x264 - 0xA7CB), (0xA7CC, 0xA7CE, 2, 1), (0xA7D2, 0xA7D4, 2, 1), (0xA7DA, 0xA7DA, 1, 1), (0xA7DC, 0xA7DC, 1, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 1, 0x20), (0x16EA0, 0x16EB8, 1, 0x1B),
)
_SMALL = {c: c + far for first, last, step, far in _PAIRS for c in range(first, last + 1, step)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _SMALL)) + "]")
_first, _second, _third = map(itemgetter, range(3))
_BLANK = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in keep else spare))
        spare += b not in keep
    return out


class Automaton:
    """The compiled merges. vocab: token to id; merges: pairs in order of rank; suffix: the mark on a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        parts = {a + b: (a, b) for a, b in reversed(merges)}
        base = [t for t in vocab if t not in parts]
        order = base + [a + b for a, b in merges if parts[a + b] == (a, b)]
        index = {t: i for i, t in enumerate(order)}
        # a token that ends a word has no arcs out: only the others need a state
        states = [t for t in order if not (suffix and t.endswith(suffix))]
        state = {t: i for i, t in enumerate(states)}
        stride = -(-len(states) // 8) or 1
        arcs = np.zeros((len(order), stride), np.uint8)
        arcs[: len(base)] = 0xFF
        done = len(base)
        for a, b in merges:
            if parts[a + b] != (a, b):
                continue
            u, v, w = index[a], index[b], done
            s = state[a]
            byte, bit = s >> 3, np.uint8(1 << (s & 7))
            if u == v:
                arcs[v, byte] &= ~bit
            arcs[w] = arcs[u]
            if (into := state.get(a + b)) is not None:
                from_byte, from_bit = state[b] >> 3, state[b] & 7
                column = arcs[: w + 1, from_byte] >> from_bit & 1
                if u == v:  # the state of w keeps the arc that the state of u lost
                    column[v] = 1
                    column[w] = column[u]
                to = np.uint8(1 << (into & 7))
                at = arcs[: w + 1, into >> 3]
                at &= ~to
                at |= column * to
            if u != v:
                arcs[v, byte] &= ~bit
            done += 1
        state_of = np.array([state.get(t, -1) for t in order], np.int32)
        # tokens that may follow the same states share a row
        self.table, self.row = _distinct(arcs)
        del arcs
        self.state_of = np.array([state.get(t, -1) for t in order], np.int32)
        self.n_states, self.index = len(states), index
        self.ids = np.array([vocab[t] for t in order], np.int32)
        # the tokens as text: those that end a word without the suffix mark
        inner = {t: i for t, i in index.items() if t in state}
        final = {t[: len(t) - len(suffix)]: i for t, i in index.items() if suffix and t.endswith(suffix)} if suffix else inner
        symbols = byte_symbols()
        self.tabled = all(c in inner and c in final for c in symbols)
        self.symbols = symbols if self.tabled else sorted({c for texts in (inner, final) for t in texts for c in t})
        self._spell(inner, final)
        self._ready()

    def _spell(self, inner: dict[str, int], final: dict[str, int]) -> None:
        """The tokens' texts as a double array: the symbol c leads from node p to target[base[p] + c] if owner there is p; ends: tokens by node, inside and at the end of a word."""
        prefixes = {t[:k] for texts in (inner, final) for t in texts for k in range(1, len(t) + 1)}
        node = {p: i for i, p in enumerate(sorted({"", *prefixes}))}
        code = {c: k for k, c in enumerate(self.symbols)}
        below: dict[int, list[tuple[int, int]]] = {}
        for p, i in node.items():
            if p:
                below.setdefault(node[p[:-1]], []).append((code[p[-1]], i))
        n = len(self.symbols)
        self.base = np.full(len(node), -1, np.int32)
        used, last = bytearray(n * len(node) + 2 * n), 0
        owner, target = np.full(len(used), -1, np.int32), np.full(len(used), -1, np.int32)
        from_: dict[int, int] = {}  # where the last node with as many children fitted: what is before it is nearly full
        for p, children in sorted(below.items(), key=lambda x: (-len(x[1]), x[0])):
            low, at = min(c for c, _ in children), from_.get(len(children), n) - 1
            while True:
                at = used.find(0, at + 1)
                if len(children) == 1 or not any([used[at - low + c] for c, _ in children]):
                    break
            from_[len(children)] = at
            self.base[p] = at - low
            for c, i in children:
                used[at - low + c], owner[at - low + c], target[at - low + c] = 1, p, i
            last = max(last, at - low + n)
        self.base[self.base < 0] = last
        self.owner, self.target = owner[: last + n].copy(), target[: last + n].copy()
        self.ends = np.full((2, len(node)), -1, np.int32)
        for k, texts in enumerate((inner, final)):
            for t, i in texts.items():
                self.ends[k, node[t]] = i

    def _ready(self) -> None:
        self.code = {c: k for k, c in enumerate(self.symbols)}
        flat = lambda x: memoryview(np.ascontiguousarray(x).reshape(-1))
        self.flat = [flat(x) for x in (self.base, self.owner, self.target, self.ends[0], self.ends[1], self.state_of, self.row, self.table)]

    KEPT = ("suffix", "table", "row", "state_of", "n_states", "ids", "tabled", "symbols", "base", "owner", "target", "ends")

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.KEPT}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """encode() for many short words at once: words of one length step through the tables together."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            text = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(len(at), n)
            last, start = np.full((len(at), n + 1), -1, np.int32), np.zeros((len(at), n + 1), np.int32)
            for j in range(n):
                rows = np.flatnonzero(last[:, j] >= 0) if j else np.arange(len(at))
                p = self.state_of[last[rows, j]] if j else None
                node = np.zeros(len(rows), np.int32)
                for i in range(j + 1, n + 1):
                    slot = self.base[node] + text[rows, i - 1]
                    alive = self.owner[slot] == node
                    node = self.target[slot]
                    if not alive.all():
                        rows, node, p = rows[alive], node[alive], p if p is None else p[alive]
                    if not len(rows):
                        break
                    t = self.ends[int(i == n), node]
                    fits = t >= 0
                    if p is not None:
                        fits &= self.table[self.row[t], p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
                    last[rows[fits], i], start[rows[fits], i] = t[fits], j
            at_end, found, rows = np.full(len(at), n), [], np.arange(len(at))
            while at_end.any():
                found.append(np.where(at_end > 0, last[rows, at_end], -1))
                at_end = np.where(at_end > 0, start[rows, at_end], 0)
            for k, tokens in zip(at, np.stack(found[::-1], 1).tolist(), strict=True):
                out[k] = [t for t in tokens if t >= 0]
        return out

    def encode(self, word: str) -> list[int]:
        """Positions in the order of tokens; word: its symbols without the end mark. Symbols outside the vocabulary go, as without an unknown token."""
        base, owner, target, inner, final, state, row, table = self.flat
        codes = [k for c in word if (k := self.code.get(c)) is not None]

        def alone(c: int, ends: memoryview) -> bool:
            slot = base[0] + c
            return owner[slot] == 0 and ends[target[slot]] >= 0

        if codes and not self.tabled:
            whole = self.code.get(word[-1]) is not None and alone(codes[-1], final)
            codes = [c for c in codes[: len(codes) - (self.code.get(word[-1]) is not None)] if alone(c, inner)] + ([codes[-1]] if whole else [])
        n, stride = len(codes), self.table.shape[1]
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            if j and last[j] < 0:
                continue
            p = state[last[j]] if j else -1
            byte, shift, node = p >> 3, p & 7, 0
            for i in range(j + 1, n + 1):
                slot = base[node] + codes[i - 1]
                if owner[slot] != node:
                    break
                node = target[slot]
                t = inner[node] if i < n else final[node]
                if t >= 0 and (not j or table[row[t] * stride + byte] >> shift & 1):
                    last[i], start[i] = t, j
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order of appearance, and of each row which it is; told apart by 128 bits."""
    found: dict[bytes, int] = {}
    place = np.array([found.setdefault(xxhash.xxh3_128_digest(r), len(found)) for r in rows], np.int32)
    return rows[np.unique(place, return_index=True)[1]], place


class Tokenizer:
    """Encodes and decodes as a tokenizers file says: special tokens, normalizer, splitting, byte symbols, merges."""

    def __init__(self, file: bytes, cache: int = 120_000):
        spec = json.loads(file)
        model = spec.pop("model")
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._ready({k: spec[k] for k in ("normalizer", "pre_tokenizer", "added_tokens")}, automaton, [labels.get(i, "") for i in range(max(labels) + 1)], cache)

    def _ready(self, spec: dict, automaton: Automaton, labels: list[str], cache: int) -> None:
        self.spec, self.automaton, self.label, self.room = spec, automaton, labels, cache
        self.steps = [self._step(x) for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])]
        split = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if len(split) != 1 or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            raise ValueError("one splitting pattern that keeps its matches is supported")
        self.split = regex.compile(split[0]["pattern"]["Regex"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or are normalized are not supported")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.bytes = byte_symbols()
        self.cached: dict[str, tuple[int, str, str]] = {}
        self.blank = False  # whether some chunk has no tokens
        ids = automaton.ids.tolist()
        self.id_text, self.token_text = [str(i) for i in ids], [labels[i] for i in ids]
        self.alone = [(1, a, b) for a, b in zip(self.id_text, self.token_text)]  # of words that are one token

    def __getstate__(self) -> tuple:
        return self.spec, self.automaton, "\n".join(self.label), self.room

    def __setstate__(self, state: tuple) -> None:
        spec, automaton, labels, room = state
        self._ready(spec, automaton, labels.split("\n"), room)

    @staticmethod
    def _step(x: dict) -> Callable[[str], str]:
        if x["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
            return lambda s, form=x["type"]: unicodedata.normalize(form, s)
        if x["type"] == "Lowercase":  # each character for itself: no final sigma
            return lambda s: (s if s.isascii() else _CAPITAL.sub(lambda m: chr(_SMALL[ord(m[0])]), s).replace("Σ", "σ")).lower()
        if x["type"] == "Replace" and x["pattern"].get("Regex") == "\\s+" and x["content"] == " ":
            return lambda s: _BLANK.sub(" ", s)
        raise ValueError(f"normalizer {x['type']} is not supported")

    def _words(self, piece: str) -> list[str]:
        """The pre-split words of a normalized text without special tokens and white space."""
        if piece.isalpha():
            return [piece]
        if piece.isascii():
            return [piece[:-1], piece[-1]] if piece[:-1].isalpha() and piece[-1] in ",.;:!?" else self.split.findall(piece)
        # the pattern's tables may be newer than the library's
        return [piece[m.start() : m.end()] for m in self.split.finditer(_LATER.sub("\x01", piece))]

    def _normal(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def _parts(self, chunks: list[str]) -> list[list[int | str]]:
        """For each chunk the ids of special tokens and the words, in order."""
        out: list[list[int | str]] = [[]] * len(chunks)
        plain = []
        for k, c in enumerate(chunks):
            if self.special and "<" in c and self.special.search(c):
                out[k] = [x for j, part in enumerate(self.special.split(c)) if part for x in ([self.specials[part]] if j % 2 else self._words(self._normal(part)))]
            else:
                plain.append(k)
        # what has no white space can be normalized together, parted by spaces
        for k, c in zip(plain, self._normal(" ".join([chunks[k] for k in plain])).split(" ") if plain else [], strict=True):
            out[k] = self._words(c)
        return out

    def _learn(self, words: list[str]) -> dict[str, tuple[int, str, str]]:
        """Words' numbers of tokens, ids and labels, each joined by spaces."""
        auto, raw = self.automaton, [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG] if auto.tabled else []
        found: list[list[int] | None] = [None] * len(words)
        for k, tokens in zip(short, auto.encode_many([raw[k] for k in short]), strict=True):
            found[k] = tokens
        ids, label, alone = self.id_text, self.token_text, self.alone
        out = {}
        for k, w in enumerate(words):
            if (tokens := found[k]) is None:
                tokens = auto.encode("".join([self.bytes[b] for b in raw[k]]))
            out[w] = alone[tokens[0]] if len(tokens) == 1 else (len(tokens), " ".join([ids[t] for t in tokens]), " ".join([label[t] for t in tokens]))
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """The text between white space. str.split() would also split at U+001C to U+001F."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in _BLANK.split(text) if c]
        return text.split()

    def entries(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text its chunks' entries. Works on some millions of characters at a time."""
        k = 0
        while k < len(texts):
            size, some = 0, []
            while k < len(texts) and (not some or size < BLOCK):
                some.append(self._chunks(texts[k]))
                size += len(texts[k])
                k += 1
            wanted = set().union(*some)
            new = [*wanted.difference(self.cached)]
            parts, cached = self._parts(new), self.cached
            words = self._learn([*{w for p in parts for w in p if isinstance(w, str)}])
            for c, p in zip(new, parts, strict=True):
                if len(p) == 1 and p[0] in words:
                    cached[c] = words[p[0]]
                else:
                    found = [words[w] if isinstance(w, str) else (1, str(w), self.label[w]) for w in p]
                    found = [f for f in found if f[0]]
                    cached[c] = (sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found]))
                self.blank = self.blank or not cached[c][0]
            get = self.cached.__getitem__
            for chunks in some:
                yield [*map(get, chunks)] if not self.blank else [e for e in map(get, chunks) if e[0]]
            if len(cached) > self.room:  # what was met again stays
                again = wanted.difference(new)
                self.cached = {c: cached[c] for c in again} if len(again) <= self.room else {}

    def forget(self) -> None:
        """Gives the cache's memory back: Python workers outlive a task."""
        self.cached, self.blank = {}, False
        release_memory()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for e in found for i in e[1].split()] for found in self.entries(texts)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, special tokens included; without a decoder they are joined by spaces."""
        return " ".join([self.label[i] for i in ids])

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of what decode gives, for each text."""
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for found in self.entries(texts):
            yield sum(map(_first, found)), sha(" ".join(map(_second, found))), sha(" ".join(map(_third, found)))


_packed: dict[str, bytes] = {}
_loaded: dict[int, Tokenizer] = {}


def packed(spark: SparkSession, file: bytes) -> bytes:
    """The compiled tokenizer as some megabytes. A task compiles it: the bit table takes a hundred megabytes until equal rows are shared. Kept for later queries."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _packed:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([pa.array([zlib.compress(pickle.dumps(Tokenizer(file)), 1)], pa.binary())], ["packed"])
            release_memory()

        _packed[key] = bytes(spark.range(0, 1, 1, 1).mapInArrow(run, "packed binary").first()[0])
    return _packed[key]


def loaded(tables: bytes) -> Tokenizer:
    """One tokenizer for each Python worker. The many small cache entries hold no cycles: the collector is off."""
    gc.disable()
    key = zlib.crc32(tables)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(zlib.decompress(tables))
    return _loaded[key]


def encode_digests(docs: DataFrame, tokenizer_file: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    docs: doc_id and text; other columns are ignored. A null text counts as
    empty, an empty text has no tokens; repeated rows give repeated rows, null
    doc_ids stay null. tokenizer_file: the content of the tokenizer's JSON
    file, whose size bounds what goes with the tasks. Very long texts cost time
    in proportion; an empty table gives no rows.
    """
    tables = packed(docs.sparkSession, tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n, ids, labels = zip(*t.digests([x or "" for x in b.column(1).to_pylist()]), strict=True)
                yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(labels, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode_documents(docs: DataFrame, tokenizer_file: bytes) -> DataFrame:
    """doc_id, source, n_tokens, token_ids array<int>, ids_sha256 and decoded_sha256 of every row; nulls as in encode_digests.

    docs: doc_id, text and source; other columns are ignored.
    """
    tables = packed(docs.sparkSession, tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(tables)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # ids of so many texts are held at once
                b = whole.slice(at, 1000)
                n, ids, shas, decoded = [], [], [], []
                for found in t.entries([x or "" for x in b.column(2).to_pylist()]):
                    text = " ".join(map(_second, found))
                    ids.append(np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32))
                    n.append(len(ids[-1]))
                    shas.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join(map(_third, found)).encode()).hexdigest())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), lists, pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"])
        t.forget()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, source string, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string")
