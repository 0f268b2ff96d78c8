"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded by the library alone; those that come back as their own single token are proven.
A text is normalised and cut into pre-tokens as the tokenizer states; a proven pre-token counts 1 and only the rest is merged by the library,
once for each different pre-token while it is remembered (``REMEMBER`` at most, then forgotten together).

For tokenizers of lower-cased words with word ends: NFC, white space to one space, lower case; contractions, runs of letters, single numerals
and runs of other signs. A text that holds the string of an added token goes whole through the library, which treats it in its default way.

Cases: a null text counts as empty, 0 bytes and 0 tokens. Repeated rows are counted each; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

NAME, LIMIT, REMEMBER, CHUNK = "word_bpe_49k.json", 2048, 400_000, 1 << 20
# Fixed value: the tokenizer's own pattern of pre-tokens, with white space written out.
_SPACE = r"\t-\r\x20\x85\xA0  -     　"
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts of whole texts; made once in each Python worker from the tokenizer's file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.added = [t["content"] for t in stated["added_tokens"]]
        self.whole = self._proven(stated["model"])
        self.merged: dict[str, int] = {}

    def _proven(self, model: dict) -> dict[str, int]:
        end, of = model["end_of_word_suffix"], _bytes_of_symbols()
        texts = {}
        for token, i in model["vocab"].items():
            if token.endswith(end) and all(c in of for c in token[: -len(end)]):
                try:
                    texts[bytes(of[c] for c in token[: -len(end)]).decode()] = i
                except UnicodeDecodeError:
                    continue
        found = self.library.encode_batch_fast(list(texts), add_special_tokens=False)
        return {t: 1 for (t, i), e in zip(texts.items(), found, strict=True) if e.ids == [i] and PRETOKEN.fullmatch(t)}

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return PRETOKEN.findall(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        special = [any(a in t for a in self.added) for t in texts]
        cut = [[] if s else self.pretokens(t) for s, t in zip(special, texts, strict=True)]
        rest = set().union(*cut) - self.whole.keys() - self.merged.keys()
        if len(self.merged) + len(rest) > REMEMBER:
            self.merged = {}
            rest = set().union(*cut) - self.whole.keys()
        rest = list(rest)
        self.merged.update(zip(rest, (len(e.ids) for e in self.library.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        get = (self.merged | self.whole).__getitem__ if len(self.merged) < 1000 else None
        whole, merged = self.whole, self.merged
        out = []
        for s, t, c in zip(special, texts, cut, strict=True):
            if s:
                out.append(len(self.library.encode(t, add_special_tokens=False).ids))
            elif get:
                out.append(sum(map(get, c)))
            else:
                out.append(sum([1 if p in whole else merged[p] for p in c]))
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, name: str = NAME, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; ``name`` is a file of the public tokenizers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = public_tokenizers.path(name)
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            n, i = [], 0
            while i < len(texts):
                j, most = i + 1, int(size[i])
                while j < len(texts) and most + size[j] <= CHUNK:
                    most += int(size[j])
                    j += 1
                n += counter.count(texts[i:j].to_pylist())
                i = j
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
