"""Token counts without token ids: pieces are counted once for each distinct pre-token.

No piece of these tokenizers crosses white space: their splitter keeps no match with white space in it, and
their normaliser changes no character by one beyond it. So a text's pre-tokens are what ASCII white space
separates, and the number of pieces is a function of the pre-token. Each task keeps that function as a
table (pre-token, pieces), filled once per distinct pre-token, and joins it to the pre-token frequencies
of each document; the products are summed. The join stays in the task: by the law of word frequencies its
table is a small part of the task's text, whereas a shuffle would move a row for each document and word.
The table is emptied when it reaches `table_rows`, so memory is bounded.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, kind_of, texts


class PieceTable:
    """Pre-token -> number of pieces for one tokenizer file (JSON), as its library counts them."""

    def __init__(self, path: str, table_rows: int = 1 << 19) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only special strings that are matched in the raw text as they are")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"]:
            raise ValueError("the splitter must keep the matches of one pattern, none of them with white space")
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.first = {t[:2] for t in specials}
        # special strings are taken out first; what is left has none
        self.model = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
        # a run of ASCII letters is one pre-token of the model, in lower case and byte for byte, if the file
        # says so; the model then counts it by itself
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        plain = normal == ["NFC", "Replace", "Lowercase"] and "|[\\p{L}]+|" in steps[0]["pattern"]["Regex"]
        self.letters = self.model.model.tokenize if plain else None
        self.pieces: dict[bytes, int] = {}
        self.table_rows = table_rows

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text, and how many special strings it holds."""
        special = len(self.special.findall(text)) if self.special and any(f in text for f in self.first) else 0
        out: Counter = Counter()
        for part in self.special.split(text) if special else [text]:
            out.update(part.encode().split())
        return out, special

    def fill(self, wanted: set[bytes]) -> None:
        """Count the pieces of the pre-tokens that the table lacks."""
        if len(self.pieces) + len(wanted) > self.table_rows:
            self.pieces = {}
        new = [t for t in wanted if t not in self.pieces]
        if self.letters:
            end, other = {t: len(self.model.encode(t, add_special_tokens=False).ids) for t in (".", ",")}, []
            for t in new:
                tail = t[-1:].decode("ascii", "ignore")
                core = t[:-1] if tail in end else t
                if core.isalpha():  # of bytes: ASCII letters alone
                    self.pieces[t] = len(self.letters(core.lower().decode())) + (end[tail] if tail in end else 0)
                else:
                    other.append(t)
            new = other
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            encoded = self.model.encode_batch_fast([t.decode() for t in part], add_special_tokens=False)
            self.pieces.update(zip(part, (len(e) for e in encoded), strict=True))

    def count(self, texts_: list[str]) -> list[int]:
        """Tokens of each text."""
        found = [self.frequencies(t) for t in texts_]
        self.fill(set().union(*(f for f, _ in found)))
        pieces = self.pieces
        return [special + sum(pieces[t] * n for t, n in f.items()) for f, special in found]


def _counts(batches: Iterator[pa.RecordBatch], path: str, group: int) -> Iterator[pa.RecordBatch]:
    table = PieceTable(path)
    for batch in batches:
        for at in range(0, batch.num_rows, group):
            part = batch.slice(at, group)
            rows = list(texts(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(table.count(rows), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, group: int = 256) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    Tokens are those of Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False) over
    the whole text; special strings inside a text are one token each, as is the library's default. A null
    text counts as empty: no bytes, no tokens. Repeated rows are counted each; ids of any type, null too,
    are passed through.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    out = rows.mapInArrow(partial(_counts, path=tokenizer_path, group=group), f"id {kind_of(rows, 'id')}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
