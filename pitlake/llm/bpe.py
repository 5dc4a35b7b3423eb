"""Exact byte-pair encoding by backtracking, and decoding from an offset table.

A word's tokens are found in linear time without replaying merges: one
Aho-Corasick pass gives the longest token that starts at each position; the
encoder takes it if it may follow the token before it, else the next shorter
prefix token, else it steps back. Whether two tokens may stand side by side is
decided once per pair from the merge table (the pair is compatible if merging
their joint text gives back just these two) and remembered. Decoding copies
slices of one long string of all tokens, addressed by an offset table.

The vocabulary file is a parameter; its merges must be listed in rank order
with ids that rise with the rank, as in the common format.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\0"  # stands for the end-of-word suffix inside automaton keys; byte characters never include it
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
CACHE = 150_000  # pieces in each of two generations
LONG = 64  # longer pieces aren't kept


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.table = {b: c for b, c in byte_characters().items()}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.key: list[str] = [""] * size
        for token, i in self.vocab.items():
            self.key[i] = token[: -len(suffix)] + END if suffix and token.endswith(suffix) and token != suffix else token
        by_key = {k: i for i, k in enumerate(self.key) if k}
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        made = set()
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b] if not suffix or not a.endswith(suffix) else -1
            if k < 0 or k in made or not self.compatible(i, j):
                continue
            made.add(k)
            self.merged[i, j], self.left[k], self.right[k] = k, i, j
        usable = {i for k, i in by_key.items() if len(k.rstrip(END)) == 1 or i in made}
        self.fits = {}
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for k, i in by_key.items():
            if i in usable:
                self.automaton.add_word(k, (len(k), i))
                self.shorter[i] = next((p for n in range(len(k) - 1, 0, -1) if (p := by_key.get(k[:n], -1)) in usable), -1)
        self.automaton.make_automaton()
        self.text, self.offset = "", [0]
        names = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = token
        for n in names:
            self.offset.append(self.offset[-1] + len(n))
        self.text = "".join(names)
        self.new: tuple[dict, dict] = ({}, {})
        self.old: tuple[dict, dict] = ({}, {})

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of a and b gives a, b: no merge across their border comes first."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit, out = a, b, 1 << 60, True
        while True:
            if self.merged.get((x, y), 1 << 60) < limit:
                out = False
                break
            # undo whichever of the two was merged last; its border part stood alone before that
            if x > y:
                limit, whole = x, x
                x = self.right[x]
                if x == whole:
                    limit, whole = y + 1, y
                    y = self.left[y]
                    if y == whole:
                        break
            else:
                limit, whole = y + 1, y
                y = self.left[y]
                if y == whole:
                    limit, whole = x, x
                    x = self.right[x]
                    if x == whole:
                        break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word; time is linear in its length."""
        s = word.encode("utf-8").decode("latin-1").translate(self.table) + END
        whole = self.vocab_key(s)
        if whole is not None:
            return whole
        n = len(s)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(s):
            longest[end - size + 1] = i  # ends rise, so the longest comes last
        open_at = bytearray(b"\1") * (n + 1)
        open_at[n - 1] = 0  # the suffix mark isn't a token of its own
        out: list[int] = []
        at, token = 0, longest[0]
        fits, key, shorter = self.fits, self.key, self.shorter
        while True:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(key[token])
                if open_at[end]:
                    ok = last < 0 or fits.get((last, token))
                    if ok is None:
                        ok = self.compatible(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(key[token])

    def vocab_key(self, s: str) -> list[int] | None:
        found = self.automaton.get(s, None)
        return [found[1]] if found else None

    def learn(self, piece: str) -> str:
        """Fill the cache for a piece without white space."""
        ids = self.old[0].get(piece)
        if ids is None:
            got = [i for w in WORDS.findall(piece) for i in self.encode_word(w)]
            ids, decoded = " ".join(map(str, got)), self.decode(got)
        else:
            decoded = self.old[1][piece]
        self.new[0][piece], self.new[1][piece] = ids, decoded
        return ids

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final form of sigma

    def segments(self, text: str) -> Iterator[str]:
        return iter(self.special_re.split(text)) if self.special_re and "<|" in text else iter((text,))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is empty."""
        out: list[int] = []
        for part in self.segments(text or ""):
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in WORDS.findall(self.normalise(part)):
                    out += self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, as the library does for a vocabulary without a decoder."""
        text, offset = self.text, self.offset
        return " ".join([text[offset[i] : offset[i + 1]] for i in ids])

    def both(self, text: str | None) -> tuple[str, str]:
        """(ids as decimals joined by a space, decoded text), by way of the cache of pieces."""
        ids_out, text_out = [], []
        for part in self.segments(text or ""):
            if part in self.special:
                ids_out.append(str(self.special[part]))
                text_out.append(part)
                continue
            part = self.normalise(part)
            pieces = [p for p in regex.split(r"\s+", part) if p] if ODD_SPACE.search(part) else part.split()
            if len(self.new[0]) > CACHE:
                self.old, self.new = self.new, ({}, {})
            ids, decoded = self.new
            once = {}
            for p in pieces:
                if p not in ids:
                    self.learn(p)
                    if len(p) > LONG:
                        once[p] = None
            if pieces:
                ids_out.append(" ".join([ids[p] for p in pieces]))
                text_out.append(" ".join([decoded[p] for p in pieces]))
            for p in once:
                del ids[p], decoded[p]
        return " ".join(ids_out), " ".join(text_out)


_CODECS: dict[str, Codec] = {}


def codec(spec_text: str) -> Codec:
    """The codec of a vocabulary's JSON, built once in a process."""
    mark = hashlib.sha1(spec_text.encode()).hexdigest()
    if mark not in _CODECS:
        _CODECS.clear()
        _CODECS[mark] = Codec(json.loads(spec_text))
    return _CODECS[mark]


def with_codes(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with `full` also (ids array<int>, decoded string).

    * one row per input row, repeated rows included; null text is empty; null ids stay null.
    * an empty text has no tokens, and the digests are those of the empty string.
    * other columns are ignored; an empty table gives an empty result.
    * the vocabulary's size bounds what is broadcast.
    """
    with open(vocab_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1):
                    ids, decoded = c.both(t.as_py())
                    row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + ((list(map(int, ids.split())), decoded) if full else ()))
                columns = list(zip(*rows))
                arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    import public_tokenizers

    return with_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
