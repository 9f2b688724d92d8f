"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's exact merges are the one sequence of tokens in which every neighbouring pair is compatible: no pair may have been
merged before the merges that built its two tokens.  An Aho-Corasick pass over the word gives, for each start, the longest
token there; the encoder takes it, checks the pair with its predecessor against the pair table, and tries the next shorter
token or steps back where the pair is not compatible.  A position from which the encoder has stepped back is never entered
again, so the work is linear in the word.

The tokenizer's last symbol of a word carries an end mark, so a word is a string over two alphabets: bytes, and last
bytes.  Words that a task has met are remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from sparkloom.llm.common import fresh, with_fields

#: Unicode's White_Space, at which the tokenizer's patterns break.
SPACE = "\t-\r \x85\xa0  -     　"
#: Bytes, that each of the two memories of a worker holds at most.
REMEMBERED = 128 << 20


#: The letters and numbers that Unicode 16 adds to the 15.1 of Python's `unicodedata`.
NEW_LETTERS = (
    (0x1c89, 0x1c8a), (0xa7cb, 0xa7cd), (0xa7da, 0xa7dc), (0x105c0, 0x105f3), (0x10d4a, 0x10d65), (0x10d6f, 0x10d85),
    (0x10ec2, 0x10ec4), (0x11380, 0x11389), (0x1138b, 0x1138b), (0x1138e, 0x1138e), (0x11390, 0x113b5), (0x113b7, 0x113b7),
    (0x113d1, 0x113d1), (0x113d3, 0x113d3), (0x11bc0, 0x11be0), (0x13460, 0x143fa), (0x16100, 0x1611d), (0x16d40, 0x16d6c),
    (0x18cff, 0x18cff), (0x1e5d0, 0x1e5ed), (0x1e5f0, 0x1e5f0),
)
NEW_NUMBERS = (
    (0x10d40, 0x10d49), (0x116d0, 0x116e3), (0x11bf0, 0x11bf9), (0x16130, 0x16139), (0x16d70, 0x16d79), (0x1ccf0, 0x1ccf9),
    (0x1e5f1, 0x1e5fa),
)
#: Lower-case letters of Unicode 16 and 17 that `str.lower` does not know.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_new = re.compile(f"[{''.join(map(chr, NEW_LOWER))}]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others
    follow from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """The contents of `\\p{L}`, `\\p{N}` and `\\s` as ranges, for Python's own expressions."""
    ranges: dict[str, list[list[int]]] = {"L": [[*x] for x in NEW_LETTERS], "N": [[*x] for x in NEW_NUMBERS]}
    for c in range(0x110000):
        if (kind := unicodedata.category(chr(c))[0]) in ranges:
            if ranges[kind] and ranges[kind][-1][1] == c - 1:
                ranges[kind][-1][1] = c
            else:
                ranges[kind].append([c, c])
    return {f"\\p{{{k}}}": "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in v) for k, v in ranges.items()} | {"\\s": SPACE}


def explicit(pattern: str) -> str:
    """A pattern whose property classes are written out, bracketed where they stand alone."""
    for name, content in classes().items():
        pattern = pattern.replace(f"[{name}]", name)
        pattern = re.sub(r"\[\^[^\]]*\]", lambda m, n=name, c=content: m[0].replace(n, c), pattern).replace(name, f"[{content}]") if name in pattern else pattern
    return pattern


#: Pairs of tokens whose compatibility a worker remembers.
SEAMS = 400_000


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Memory(dict):
    """What short texts were encoded to; forgets all when it holds REMEMBERED bytes."""

    held = 0

    def keep(self, text: str, found: bytes) -> None:
        if len(text) <= 64:
            if self.held >= REMEMBERED:
                self.clear()
                self.held = 0
            self.held += 200 + 2 * len(text) + len(found)  # the objects and their place in the table
            self[text] = found


class WordBPE:
    """A byte-level BPE tokenizer with word ends, read from the JSON text of its file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = re.compile(explicit(pattern))
        self.chunks = re.compile(f"[^{SPACE}]+")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        symbol = {c: b for b, c in enumerate(byte_symbols())}

        def spell(token: str) -> str:
            """A token over the alphabet of bytes (U+0000..) and last bytes (U+0100..)."""
            last = bool(self.suffix) and token.endswith(self.suffix)
            units = [symbol[c] for c in (token.removesuffix(self.suffix) if last else token)]
            return "".join(map(chr, units[:-1])) + chr(units[-1] + 256 * last)

        # how each token was merged, and its place in the order of merges; single symbols come first
        self.left, self.right, self.rank = list(range(size)), list(range(size)), [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.pair:
                self.pair[x, y] = z
                if self.rank[z] < 0:
                    self.left[z], self.right[z], self.rank[z] = x, y, n
        self.spelt = {}
        for token, i in vocab.items():
            if token not in self.added and (len(s := spell(token)) == 1 or self.rank[i] >= 0):
                self.spelt[s] = i
        self.search = ahocorasick.Automaton()
        for s, i in self.spelt.items():
            self.search.add_word(s, (len(s), i))
        self.search.make_automaton()
        self.length = [0] * size
        self.shorter = [-1] * size
        for s, i in self.spelt.items():
            self.length[i] = len(s)
            self.shorter[i] = next((self.spelt[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.spelt), -1)
        # decoding: all tokens' texts behind one another, each followed by the space that joins them
        texts = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            texts[i] = token.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.words, self.pieces = Memory(), Memory()
        self.seams: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether `a` and `b` stay side by side: taken apart merge by merge from the latest on, no pair along their seam
        merges before the parts that it would cut."""
        rank, left, right, pair = self.rank, self.left, self.right, self.pair
        limit = 1 << 60
        while True:
            z = pair.get((a, b))
            if z is not None and rank[z] < limit:
                return False
            # undo the later of the two merges at the seam; of equal ones the right one came later
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """`compatible`, remembered."""
        key = a << 32 | b
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            found = self.seams[key] = self.compatible(a, b)
        return found

    def word(self, text: str) -> list[int]:
        """The tokens of one piece that the pre-tokenizer cut."""
        data = text.encode("utf-8", "surrogatepass").decode("latin-1")
        if self.suffix:
            data = data[:-1] + chr(ord(data[-1]) + 256)
        n = len(data)
        longest = [-1] * n
        for end, (size, token) in self.search.iter(data):
            start = end - size + 1
            if longest[start] < 0 or self.length[longest[start]] < size:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:  # nothing fits here: never come back, and shorten the token before
                dead[at] = 1
                while True:
                    token = out.pop()
                    at -= self.length[token]
                    if self.shorter[token] >= 0:
                        token = self.shorter[token]
                        break
                    dead[at] = 1
        return out

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            found = packed(self.word(text))
            self.pieces.keep(text, found)
        return found

    def chunk(self, text: str) -> bytes:
        """The ids of what stands between two white spaces."""
        found = self.words.get(text)
        if found is None:
            found = b"".join(map(self.piece, self.pattern.findall(text)))
            self.words.keep(text, found)
        return found

    def normal(self, text: str) -> str:
        """Composed, then lower-cased character by character (a last sigma as any sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
            if _new.search(text):
                text = text.translate(NEW_LOWER)
        return text.lower()

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.chunk, self.chunks.findall(self.normal(text))))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; special tokens in it are themselves."""
        if self.special is None or "<|" not in text:
            return np.frombuffer(self.ordinary(text), "<u4")
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.ordinary(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self.ordinary(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by spaces, in UTF-8: a gather of byte ranges by the offset table."""
        if not len(ids):
            return b""
        parts = []
        for i in range(0, len(ids), 1 << 20):
            some = ids[i : i + (1 << 20)].astype(np.int64)
            start, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(size)
            parts.append(self.blob[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(parts)[:-1]


_loaded: dict[str, WordBPE] = {}


def loaded(text: str) -> WordBPE:
    """One tokenizer a Python worker and file."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBPE(text)
    return _loaded[key]


#: What `encode_texts` gives on request, with its type.
OUTPUTS = {"ids": (pa.list_(pa.int32()), ArrayType(IntegerType())), "decoded": (pa.binary(), BinaryType()), "n_tokens": (pa.int64(), LongType()), "ids_sha256": (pa.string(), StringType()), "decoded_sha256": (pa.string(), StringType())}


def encode_texts(docs: DataFrame, path: str, *, outputs: tuple[str, ...] = ("ids", "decoded"), text_col: str = "text") -> DataFrame:
    """`docs` with what is asked for of each whole text, by the tokenizer file at `path`: ids (array<int>), decoded (string,
    what the ids decode to), n_tokens, and the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text.

    The driver reads the file and sends it to the tasks, so executors need no copy.  A null text is empty; empty texts
    have no ids and decode to an empty text; all rows and columns come back, old columns of the outputs' names replaced.
    """
    held = fresh(docs, "_text")
    rest = docs.withColumn(held, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).drop(*outputs)
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for rows in slices(batch.columns[-1]):
                some = batch.slice(*rows)
                ids = [bpe.encode(t.as_py()) for t in some.columns[-1]]
                back = [bpe.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & {*outputs} else []
                made = {"decoded": lambda: back, "n_tokens": lambda: list(map(len, ids)), "ids_sha256": lambda: [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in back], "ids": lambda: [x.astype(np.int32) for x in ids]}  # noqa: B023
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *(pa.array(made[o](), OUTPUTS[o][0]) for o in outputs)], [*some.schema.names[:-1], *outputs])

    found = rest.mapInArrow(run, with_fields(rest.drop(held), *((o, OUTPUTS[o][1]) for o in outputs)))
    return found.withColumn("decoded", F.col("decoded").cast("string")) if "decoded" in outputs else found


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of at most `most` bytes of text or one row."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if pa.types.is_string(texts.type) else np.array([len(t.as_py()) for t in texts])
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > first:
            yield first, i - first
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts) - first
