"""2. SentencePiece (BPE) encoding and decoding through a table of last tokens.

For every prefix of a text, the last token of the prefix's encoding is unique: of the vocabulary's
matches that end there (found by an Aho-Corasick automaton), it is the one that is compatible with
the last token of the shorter prefix before it, two tokens being compatible when merging their
joined text gives just these two again.  So one pass fills the table, and the ids are read off it
backwards.  The library's model file is the only input; nothing is trained.

No piece of such a model continues past a word end ("a▁") or holds a line feed; where the loaded
vocabulary confirms it, texts fall into pieces that are encoded on their own and kept in a bounded
two-generation cache.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorekeep.llm._spark import free

CACHE = 80_000  # segments in one of the two generations
LONG = 256  # longer segments aren't kept
PAIRS = 250_000
BATCH_TEXTS = 200  # texts per output batch, to bound memory


class PieceBPE:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in normal}
        self.score = {self.piece[i]: sp.get_score(i) for i in normal}
        self.byte = {int(self.piece[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unk = sp.unk_id()
        self.length = [len(p) for p in self.piece]
        if sp.encode(" a  b ") != sp.encode("▁a▁▁b▁") or self.piece[sp.encode("a")[0]][:1] != "▁" or len(self.byte) != 256:
            raise ValueError("only models with a dummy prefix, byte fallback and no other normalisation are supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        apart = not any("\n" in p or re.search("[^▁]▁", p) for p in self.id)
        self.segment = re.compile(r"\n+|▁+[^▁\n]*|[^▁\n]+" if apart else r"(?s).+").findall
        self.pairs: dict[int, bool] = {}  # of a * (number of pieces) + b
        self.alone: dict[int, bool] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored, then leftmost, neighbours until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, b: int) -> bool:
        """Is token b the encoding of its own text?"""
        ok = self.alone.get(b)
        if ok is None:
            ok = self.alone[b] = self.merge(self.piece[b]) == [self.piece[b]]
        return ok

    def fits(self, a: int, b: int) -> bool:
        """Is (a, b) the encoding of their joined text?"""
        ok = self.pairs.get(a * len(self.piece) + b)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a * len(self.piece) + b] = self.merge(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return ok

    def segment_ids(self, text: str) -> list[int]:
        """Ids of a text in which spaces are ▁, by the table of last tokens."""
        last: list[int | None] = [None] * (len(text) + 1)
        length, pairs, fits, n = self.length, self.pairs, self.fits, len(self.piece)
        for end, b in self.automaton.iter(text):
            if last[end + 1] is None:
                a = last[end + 1 - length[b]]
                if a is None:  # the text's start, or after a character outside the vocabulary, which never merges
                    if (end + 1 == length[b] or text[end - length[b]] not in self.id) and self.stands(b):
                        last[end + 1] = b
                else:
                    ok = pairs.get(a * n + b)
                    if fits(a, b) if ok is None else ok:
                        last[end + 1] = b
        out: list[int] = []
        i = len(text)
        while i > 0:
            b = last[i]
            if b is None:
                out.extend(self.byte[x] for x in reversed(text[i - 1].encode()))
                i -= 1
            else:
                out.append(b)
                i -= length[b]
        out.reverse()
        return out

    def segment_text(self, ids: list[int]) -> str:
        """Decoded text of ids, the first space kept."""
        out, raw, of = [], bytearray(), self.byte_of
        for i in ids:
            if i in of:
                raw.append(of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.piece[i].replace("▁", " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def coded(self, segment: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, their decoded text) of a segment."""
        got = self.young.get(segment)
        if got is None:
            got = self.old.get(segment)
            if got is None:
                ids = self.segment_ids(segment)
                text = self.segment_text(ids)
                got = (",".join(map(str, ids)), len(ids), segment if text == segment else text)
            if len(segment) <= LONG:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[segment] = got
        return got

    def coded_text(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, their number, their decoded text) of a whole text; a null is empty."""
        if not text:
            return "", 0, ""
        get, coded = self.young.get, self.coded
        got = [get(s) or coded(s) for s in self.segment("▁" + text.replace(" ", "▁"))]
        decoded = "".join([g[2] for g in got])
        return ",".join([g[0] for g in got]), sum([g[1] for g in got]), decoded[1:] if decoded[:1] == " " else decoded

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, as the library gives them without begin, end or sampling."""
        ids = self.coded_text(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library's decode gives it."""
        text = self.segment_text(ids)
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, PieceBPE] = {}


def codec(path: str) -> PieceBPE:
    """The codec of a model file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = PieceBPE(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a last column of token ids, called ids or, where docs has such a column, by a free name like it.

    A null or empty text has none.  Other columns stay as they are.
    """
    (ids,) = free(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                got = [c.encode(x) for x in part.column(b.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.int32()))], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """coded with a last column of the text that its ids give, by a free name; null ids count as none."""
    (text,) = free(coded, text)
    schema = T.StructType([*coded.schema.fields, T.StructField(text, T.StringType())])
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                got = [c.decode(x or []) for x in part.column(b.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, text])

    return coded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text), whole texts.

    Texts are encoded, and the ids decoded again, inside one Arrow pass, so that the ids, several
    times the text's size, never leave the worker.  A null counts as empty; repeated rows each give
    a row; an empty table gives none.
    """
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            out = []
            for x in b.column(1):
                ids, n, decoded = c.coded_text(x.as_py())
                out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
