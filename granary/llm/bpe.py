"""BPE encoding and decoding with an automaton built from merge gadgets.

The automaton begins with one state that loops over all base symbols. The gadget of a merge (a, b), applied in merge
order, takes the b-arc from the state that a-arcs lead to and adds ab-arcs beside the a-arcs, to where the b-arc led.
Since all arcs of one label lead to one state, a state is named by its last label, and the automaton is a table of one bit
for each state and label. `compiled` builds it merge by merge: the new label's column is that of a, its row that of b
before the merge, and the bit of (a, b) goes. States that end a word have no arcs and need no row, and labels with equal
columns share one, so a vocabulary of 49,000 takes some 26 MB; it is built once on the driver and broadcast.

The automaton accepts exactly one path for each word: its BPE encoding. Encoding runs over a word once by the table,
keeping for each prefix the one label that its path ends in. Decoding emits the labels of the arcs.

Characters that Unicode got after version 15 may be classed or lowered otherwise than the library does.
Null texts count as empty and have no tokens. Texts are whole and of any length; rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The pre-tokenizer's pattern, white space as it and the normalizer know it, and the end-of-word mark.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "[\t-\r \x85\xa0  -     　]+"
END = "</w>"
#: Most words and stretches kept with their tokens' ids; beyond that the table starts anew. It only saves work, and a worker
#: keeps it from stage to stage, so it bounds memory.
TABLE = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def compiled(labels: list[str], merges: list[tuple[str, str]], rows: dict[str, int]) -> tuple[bytes, dict[str, int]]:
    """The columns of the automaton's table, one bit for each of `rows`, and where each label's column begins.

    `labels` has the base symbols, then what each merge makes.
    """
    at = {t: i for i, t in enumerate(labels)}
    base = len(labels) - len(merges)
    table = np.zeros((len(labels), len(rows) // 8 + 1), np.uint8)
    first = np.zeros(table.shape[1] * 8, bool)
    first[[rows[t] for t in labels[:base] if t in rows]] = True
    table[:base] = np.packbits(first, bitorder="little")
    for n, (a, b) in enumerate(merges, base):
        s, r = rows[a], rows.get(b)
        after = table[:n, r >> 3] >> (r & 7) & 1 if r is not None else None  # b's row before this merge
        table[at[b], s >> 3] &= 255 ^ 1 << (s & 7)
        table[n] = table[at[a]]
        if after is not None:
            new = rows[a + b]
            table[: n + 1, new >> 3] |= np.append(after, after[at[a]]) << (new & 7)
    kinds, which = np.unique(table.view(f"V{table.shape[1]}").ravel(), return_inverse=True)
    return kinds.tobytes(), {t: int(k) * table.shape[1] for t, k in zip(labels, which.ravel(), strict=True)}


class Automaton:
    """The merges as a deterministic automaton: a table of states by labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        made = [a + b for a, b in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one label")
        labels = [*(set(vocab) - set(made)), *made]
        # A state is named by its last label; after one that ends a word nothing follows.
        self.rows = {t: i for i, t in enumerate(t for t in labels if not t.endswith(END))}
        self.table, self.column = compiled(labels, merges, self.rows)
        self.longest = max(map(len, vocab), default=0)

    def arc(self, s: str, t: str) -> bool:
        """Whether the state of label s has an arc of label t."""
        r = self.rows[s]
        return bool(self.table[self.column[t] + (r >> 3)] >> (r & 7) & 1)

    def path(self, symbols: list[str]) -> list[str]:
        """The labels of the only accepting path over the symbols."""
        n, table, column, rows = len(symbols), self.table, self.column, self.rows
        ends, sizes, states = [""], [0], [-1]
        for i in range(1, n + 1):
            t, found = "", None
            for k in range(i - 1, -1, -1):
                t = symbols[k] + t
                if len(t) > self.longest:
                    break
                if (c := column.get(t)) is None:
                    continue
                r = states[k]
                if r < 0 or table[c + (r >> 3)] >> (r & 7) & 1:
                    found = t, i - k
                    break
            assert found, "no path: a symbol is missing from the vocabulary"
            ends.append(found[0])
            sizes.append(found[1])
            states.append(rows.get(found[0], 0))
        out = []
        while n:
            out.append(ends[n])
            n -= sizes[n]
        return out[::-1]


class Chunks(dict):
    """Words, and what else stands between white space, with their tokens' ids as bytes of four each."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, c: str) -> bytes:
        words = self.tokenizer.words.findall(c)
        hit = self.tokenizer.word(c) if words == [c] else b"".join(map(self.__getitem__, words))
        if len(c) < 100:
            if len(self) >= TABLE:
                self.clear()
            self[c] = hit
        return hit


class Tokenizer:
    """A tokenizers-library file of this kind: NFC, white space, lower case; split words; byte-level BPE with word ends."""

    def __init__(self, spec: str, auto: Automaton | None = None):
        f = json.loads(spec)
        model = f["model"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ids = model["vocab"]
        special = {t["content"] for t in f["added_tokens"]}
        self.auto = auto or Automaton({t: i for t, i in self.ids.items() if t not in special}, pairs)
        self.special = {t["content"]: t["id"] for t in f["added_tokens"]}
        self.label = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words, self.space, self.symbols = regex.compile(WORDS), regex.compile(SPACE), byte_symbols()
        self.number = {i: str(i) for i in self.label}
        self.chunks = Chunks(self)

    def word(self, w: str) -> bytes:
        s = [self.symbols[b] for b in w.encode("utf-8", "surrogatepass")]
        s[-1] += END
        return array("i", map(self.ids.__getitem__, self.auto.path(s))).tobytes()

    def pieces(self, text: str) -> list[bytes]:
        """The ids of stretches of the text."""
        out = []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final-sigma rule in lower()
            part = part.lower()
            # str.split() also splits at four control characters that are no white space here.
            chunks = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else [c for c in self.space.split(part) if c]
            out += map(self.chunks.__getitem__, chunks)
        return out

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, ids joined by spaces, and the decoded text: the labels joined by spaces."""
        ids = array("i", b"".join(self.pieces(text or ""))).tolist()
        return len(ids), " ".join(map(self.number.__getitem__, ids)), " ".join(map(self.label.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids if i in self.label)


def spec_of(path: str) -> str:
    """The text of a tokenizer file, read once on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_made: dict[str, Tokenizer] = {}


def tokenizer(spec: str, auto: Automaton | None = None) -> Tokenizer:
    """One tokenizer per process; only the driver compiles, a worker is given the automaton."""
    if (key := hashlib.sha256(spec.encode()).hexdigest()) not in _made:
        _made[key] = Tokenizer(spec, auto)
    return _made[key]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`df` with the token ids of each text (array of int)."""
    return _mapped(df, path, text, [(ids, "array<int>", _ids)])


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that an array of ids stands for; ids without a label are left out and null stays null."""
    return _mapped(df, path, ids, [(out, "string", None)])


def digests(df: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """`df` with n_tokens, ids_sha256 and decoded_sha256, and the ids only where `ids` names a column for them."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    outs = [("n_tokens", "bigint", lambda n, i, d: n), ("ids_sha256", "string", lambda n, i, d: sha(i)), ("decoded_sha256", "string", lambda n, i, d: sha(d))]
    return _mapped(df, path, text, outs + ([(ids, "array<int>", _ids)] if ids else []))


def _ids(n: int, ids: str, decoded: str) -> np.ndarray:
    return np.array(ids.split(), np.int32)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`df` with each text replaced by what its tokens decode to; null stays null."""
    (out,) = fresh(df, "_decoded")
    made = _mapped(df, path, text, [(out, "string", lambda n, i, d: d)])
    return made.select(*[F.when(F.col(f"`{c}`").isNull(), None).otherwise(F.col(out)).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def _mapped(df: DataFrame, path: str, column: str, outs: list) -> DataFrame:
    if clash := {o[0].lower() for o in outs} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist")
    spec = spec_of(path)
    # Both are of the vocabulary's size, some 30 MB together.
    held = df.sparkSession.sparkContext.broadcast((spec, tokenizer(spec).auto))
    types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(*held.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                if outs[0][2] is None:
                    made = [[None if v is None else tok.decode(v) for v in b.column(at).to_pylist()]]
                else:
                    made = [[] for _ in outs]
                    for v in b.column(at):
                        got = tok.encode(v.as_py())
                        for m, o in zip(made, outs, strict=True):
                            m.append(o[2](*got))
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(m, types[o[1]]) for m, o in zip(made, outs, strict=True)]], names=[*b.schema.names, *[o[0] for o in outs]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{o[0]}` {o[1]}" for o in outs]])
    return df.mapInArrow(run, schema)
