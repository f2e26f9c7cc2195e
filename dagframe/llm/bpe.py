"""BPE encoding and decoding of whole texts with a published vocabulary whose words end in a marked symbol.

Encoding is the backtracking form: an Aho-Corasick automaton gives the longest vocabulary entry at each place of
a word; entries are laid end to end, each checked against its left neighbour in a table of compatible pairs (a pair is
compatible if the merges would never join symbols across their border), with a step back where none fits. The result is
that of the merges in rank order, in time linear in the word. Words are remembered in a bounded table.

Decoding gathers the entries' bytes from one buffer through an offset table.

Texts are treated as the vocabulary file says: its special strings are cut out first, the rest is put in NFC and lower
case and split at white space and by the file's pattern.

Defined results: a null or blank text has no ids and decodes to the empty text; repeated rows are encoded alike; extra
columns pass through, and a column named as an output is replaced.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dagframe.llm.shared import mapped

#: White space of the file's pattern; entries for what may stand in a word.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Letters and numbers newer than the library's character tables (Unicode 16), which it takes for symbols.
NEWER = (
    r"՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Lower-case forms that the library knows and Python 3.13 doesn't; sigma is lowered without its word.
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Combining marks newer than the library's normalisation tables, which leave them where they stand.
UNMOVED = (
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27"
    r"\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930"
    r"\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    r"\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
END = "</w>"
#: Words remembered by one Python worker.
REMEMBERED = 300_000
RUN_IDS = 1 << 19


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_unmoved = re.compile(f"([{UNMOVED}]+)")


def composed(text: str) -> str:
    """The text in NFC as the library makes it: a mark that its tables lack stays in place and parts what stands around it."""
    if _unmoved.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_unmoved.split(text)))


def _closed(entry: str) -> str:
    """The entry with its last symbol and the end mark as one character of the private area."""
    return f"{entry[:-5]}{chr(0xE000 + ord(entry[-5]))}" if len(entry) > 4 and entry.endswith(END) else entry


class Vocabulary:
    """A tokenizer file: entries, what each is merged from, compatible pairs, and the special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder"):
            raise ValueError("only BPE files with word ends and no decoder are known here")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.ids = {_closed(s): i for s, i in model["vocab"].items()}
        #: rank is the order of merges; single symbols come before all merges.
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = model["vocab"].get(left + right)
            a, b = model["vocab"].get(left), model["vocab"].get(right)
            if made is None or a is None or b is None:
                raise ValueError(f"merge {pair} has no entry")
            self.joined.setdefault((a, b), made)
            if made not in self.parts:
                self.parts[made] = (a, b)
                self.rank[made] = rank
        self.fits_memo: dict[tuple[int, int], bool] = {}
        #: entries that their own merges make; others never come out.
        self.live = {s: i for s, i in self.ids.items() if i not in self.parts or self._stays(*self.parts[i], self.rank[i])}
        self.shorter: dict[int, int] = {}
        self.length = {i: len(s) for s, i in self.live.items()}
        for s, i in self.live.items():
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in self.live:
                    self.shorter[i] = self.live[s[:n]]
                    break

    def _stays(self, a: int, b: int, before: float) -> bool:
        """Whether no merge of a rank under `before` joins symbols across the border of a and b."""
        while True:
            made = self.joined.get((a, b))
            if made is not None and self.rank[made] < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later of the two merges: before it, its inner part stood at the border. At equal rank a merge
            # further left comes first.
            if ra > rb:
                before, a = min(before, ra), self.parts[a][1]
            else:
                before, b = min(before, rb + 1), self.parts[b][0]

    def fits(self, a: int, b: int) -> bool:
        known = self.fits_memo.get((a, b))
        if known is None:
            if len(self.fits_memo) > 1_000_000:
                self.fits_memo.clear()
            known = self.fits_memo[a, b] = self._stays(a, b, float("inf"))
        return known


class Recent(dict):
    """A bounded table: when it is full, what was not asked for since the last time goes."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian 32-bit integers. Kept by a Python worker, with its automaton and the words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.v = vocabulary
        self.entries = ahocorasick.Automaton()
        for s, i in vocabulary.live.items():
            self.entries.add_word(s, (len(s), i))
        self.entries.make_automaton()
        self.symbols = {b: s for b, s in enumerate(_byte_symbols())}
        self.closing = {b: chr(0xE000 + ord(s)) for b, s in self.symbols.items()}
        pattern = vocabulary.pattern.replace(r"\s", SPACE)
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{NEWER}]]")
        self.split = regex.compile(f"(?V1){pattern}")
        self.cut = regex.compile("|".join(map(regex.escape, vocabulary.special)))
        self.blank = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.chunks, self.pieces = Recent(self.chunk), Recent(self.piece)

    def laid(self, word: str) -> list[int]:
        """Entries of one pre-token, given as its symbols with the last one closed."""
        v, n, longest = self.v, len(word), self.entries.iter_long
        fits, memo = v.fits, v.fits_memo
        # The longest matches end to end are the answer if every neighbouring pair fits.
        out, last, at = [], -1, 0
        for end, (_, entry) in longest(word):
            if last >= 0 and not (memo.get((last, entry)) or fits(last, entry)):
                break
            out.append(entry)
            last, at = entry, end + 1
        else:
            return out
        # From the first that doesn't fit: shorter entries, then steps back; places known to lead nowhere are closed.
        closed = set()
        length, shorter = v.length, v.shorter
        while True:
            end = at + length[entry]
            if end not in closed and (last < 0 or memo.get((last, entry)) or fits(last, entry)):
                out.append(entry)
                if end == n:
                    return out
                at, last = end, entry
                _, (_, entry) = next(longest(word, at))
            elif entry in shorter:
                entry = shorter[entry]
            elif out:
                closed.add(at)
                entry = out.pop()
                at -= length[entry]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a symbol")

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token in NFC and lower case."""
        raw = piece.encode()
        ids = self.laid("".join(map(self.symbols.__getitem__, raw[:-1])) + self.closing[raw[-1]])
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return self.pieces[chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,":
                return self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        elif chunk.isalpha() and unicodedata.is_normalized("NFC", chunk) and (low := chunk.translate(LOWER).lower()).isalpha():
            return self.pieces[low]
        out: list[bytes] = []
        at = 0
        for m in [*self.cut.finditer(chunk), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            if part:
                out += map(self.pieces.__getitem__, self.split.findall(composed(part).translate(LOWER).lower()))
            if m:
                out.append(struct.pack("<I", self.v.special[m.group()]))
                at = m.end()
        return b"".join(out)

    def text(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.blank.split(text) if self.odd.search(text) else text.split()))


class Decoder:
    """Texts of ids: entries joined by one space, as the library does for a file without a decoder."""

    def __init__(self, vocabulary: Vocabulary):
        held = [vocabulary.strings.get(i, "").encode() + b" " for i in range(max(vocabulary.strings) + 1)]
        self.sizes = np.array([len(x) for x in held], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(held), np.uint8)

    def ids(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        out = []
        for k in range(0, len(ids), RUN_IDS):  # bounds what is held besides the result
            n, first = sizes[k : k + RUN_IDS], self.offsets[ids[k : k + RUN_IDS]]
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(self.buffer[place].tobytes())
        return b"".join(out)[:-1]


_kept: dict[str, tuple[Encoder, Decoder]] = {}


def codec(vocabulary_text: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a file's content, built once in a process."""
    import hashlib

    key = hashlib.sha256(vocabulary_text.encode()).hexdigest()
    if key not in _kept:
        _kept.clear()
        v = Vocabulary(vocabulary_text)
        _kept[key] = Encoder(v), Decoder(v)
    return _kept[key]


def _mapped(df: DataFrame, source: str, outputs: list[tuple[str, T.DataType]], path: str, step) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, about 2 MB
    kept = [f for f in df.schema.fields if f.name not in {n for n, _ in outputs}]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(shared.value)
        for batch in batches:
            for first in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(first, 256)
                if part.num_rows:
                    made = step(encoder, decoder, part.column(part.schema.get_field_index(source)))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), *made], [*names, *(n for n, _ in outputs)])

    return mapped(df, run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each text as little-endian unsigned 32-bit integers in one binary column."""
    def step(encoder, decoder, column):
        return [pa.array([encoder.text(x or "") for x in column.to_pylist()], pa.binary())]

    return _mapped(df, text_col, [(ids_col, T.BinaryType())], path, step)


def decode(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids give the empty text."""
    def step(encoder, decoder, column):
        return [pa.array([decoder.ids(np.frombuffer(x or b"", "<u4")).decode() for x in column.to_pylist()], pa.string())]

    return _mapped(df, ids_col, [(decoded_col, T.StringType())], path, step)


def encode_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Both in one pass: adds the ids and the text decoded from them."""
    def step(encoder, decoder, column):
        ids = [encoder.text(x or "") for x in column.to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([decoder.ids(np.frombuffer(x, "<u4")).decode() for x in ids], pa.string())]

    return _mapped(df, text_col, [(ids_col, T.BinaryType()), (decoded_col, T.StringType())], path, step)
