"""BPE encoding and decoding by forced boundaries.

Byte pairs that occur inside no token of the vocabulary mark cuts that no merge can cross: a
merge that joins over such a pair would make a token which holds it. So a word falls into
fragments that are encoded on their own, and the ids are concatenated. Fragments repeat far
more often than words do; each worker keeps the ids of those it has met (bounded).

The vocabulary is a byte-level BPE with word ends in the format of the tokenizers library
(NFC, white space dropped, lower case, one pattern for words). A fragment at the end of a word
carries the word-end mark on its last byte.

Defined results: a null or empty text gives no ids and the decoded text ''. Special tokens in
a text become their ids, as in the library. Repeated rows are encoded one by one. Long texts
are encoded whole. Other columns pass through; one
with the name of a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Words and fragments whose ids a worker keeps, twice each: when a store is full it becomes the old one, and
#: what the old one held longer than that is forgotten.
KEPT_FRAGMENTS = 80_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on this machine (all machines have the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """encode() and decode() of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.letters = byte_letters()
        as_byte = {c: i for i, c in enumerate(self.letters)}
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.spaces = regex.compile(r"\s+")
        # Letters whose classes and cases differ between releases of Unicode are left to the library's own
        # normaliser and word pattern; the fragments are encoded here all the same.
        self.newer = regex.compile(r"[^\x00-\u024F\u0370-\u04FF\u1E00-\u1EFF\u2000-\u206F\u20A0-\u20BF]")
        self.path = path
        self.as_byte = as_byte
        self._library = None
        # pair of ids -> (rank, id of the merged token)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.byte_id = [vocab[c] for c in self.letters]
        self.last_id = [vocab[c + self.end] for c in self.letters]
        # joins[a, b]: some token holds byte a right before byte b
        self.joins = np.zeros((256, 256), bool)
        for t in vocab:
            t = t.removesuffix(self.end) if self.end else t
            bytes_ = [as_byte[c] for c in t if c in as_byte]
            self.joins[bytes_[:-1], bytes_[1:]] = True
        self.cuts = (~self.joins).tolist()
        self.known: dict[tuple[bytes, bool], list[int]] = {}
        self.known_words: dict[str, list[int]] = {}
        self.old_words: dict[str, list[int]] = {}

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """(fragment, whether it ends the word) between the forced boundaries."""
        cuts = self.cuts
        at = [i for i in range(1, len(word)) if cuts[word[i - 1]][word[i]]]
        if not at:
            return [(word, True)]
        edges = [0, *at, len(word)]
        return [(word[a:b], b == len(word)) for a, b in zip(edges, edges[1:], strict=False)]

    def merged(self, fragment: bytes, last: bool) -> list[int]:
        """Ids of one fragment: the lowest rank first, the leftmost of equal ones."""
        ids = [self.byte_id[b] for b in fragment]
        if last:
            ids[-1] = self.last_id[fragment[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := merges.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], m[1], ids[before[i]], new))
        return [x for x in ids if x >= 0]

    def _word(self, word: bytes) -> list[int]:
        out: list[int] = []
        for key in self.fragments(word):
            ids = self.known.get(key)
            if ids is None:
                ids = self.merged(*key)
                if len(key[0]) <= 64:
                    if len(self.known) >= KEPT_FRAGMENTS:
                        self.known.clear()
                    self.known[key] = ids
            out += ids
        return out

    def _split_by_library(self, part: str) -> list[bytes]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        lib = self._library
        return [bytes(map(self.as_byte.__getitem__, w)) for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii() and self.newer.search(part):
                for raw in self._split_by_library(part):
                    out += self._word(raw)
                continue
            if not part.isascii():
                part = self.spaces.sub(" ", unicodedata.normalize("NFC", part))
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            else:
                part = part.lower()
            known = self.known_words
            for word in self.words.findall(part):
                ids = known.get(word)
                if ids is None:
                    ids = self.old_words.get(word)
                    if ids is None:
                        ids = self._word(word.encode())
                    if len(word) <= 64:
                        if len(known) >= KEPT_FRAGMENTS:
                            self.old_words, self.known_words = known, {}
                            known = self.known_words
                        known[word] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between; the file names no decoder, so the library does the same."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


_coders: dict[str, ForcedBoundaryBPE] = {}


def coder(path: str) -> ForcedBoundaryBPE:
    """The coder of a vocabulary file, made once in each worker."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryBPE(path)
    return _coders[path]


def encoded(df: DataFrame, path: str, text: str = "text", ids: str | None = "ids", decoded: str | None = "decoded", count: str | None = None, ids_digest: str | None = None, decoded_digest: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with the columns that have a name: array of ids, decoded text, number of ids, SHA-256 of the ids
    (little-endian 32-bit) and of the decoded text. keep: the columns of df to return (default all)."""
    common.python_ready(df.sparkSession)
    made = [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType()), (count, T.LongType()), (ids_digest, T.StringType()), (decoded_digest, T.StringType())]
    keep = common.kept(df.columns if keep is None else keep, [n for n, _ in made if n])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made if n])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path)
        for frame in frames:
            all_ids, texts = [bpe.encode(t) for t in frame[text]], None
            out = frame[keep].copy()
            if decoded or decoded_digest:
                texts = [bpe.decode(x) for x in all_ids]
            if ids:
                out[ids] = all_ids
            if decoded:
                out[decoded] = texts
            if count:
                out[count] = [len(x) for x in all_ids]
            if ids_digest:
                out[ids_digest] = [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in all_ids]
            if decoded_digest:
                out[decoded_digest] = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            yield out

    return df.mapInPandas(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, vocabulary_path(), ids=None, decoded=None, count="n_tokens", ids_digest="ids_sha256", decoded_digest="decoded_sha256", keep=["doc_id"])
