"""Token counts by field and section, from one encoding of the whole document.

A document is the texts of its fields joined by a separator and is encoded
once. Token lengths in bytes give every token's span; spans of fields, or of
the lines of the last field, are met by an interval join of two sorted lists.
A token across a boundary goes by an explicit rule:

* ``majority``: the section that has most of its bytes, of equal shares the first;
* ``start``: the section of its first byte;
* ``fraction``: every section its share, by bytes.

A separator between fields counts to the field before it, a line's break to
its line. The sections of a document so cover it, and their tokens add up to
the document's.

Defined cases: a null field is empty; a document without any byte has no row; empty sections that hold no byte have no tokens
but a row; repeated rows are counted one by one; an empty table gives an empty result. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .storage import bounded_batches
from .text import text_bytes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's public tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())])


def allocate(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``ends``: of tokens, ``cuts``: of sections, both cover the same bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(cuts, starts, "right")
    last = np.searchsorted(cuts, ends, "left")
    out = np.bincount(first, minlength=len(cuts)).astype(float)[: len(cuts)]
    for t in np.flatnonzero(last > first) if rule != "start" else ():
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(cuts[parts], ends[t]) - np.maximum(np.concatenate([[0], cuts])[parts], starts[t])
        out[first[t]] -= 1
        if rule == "fraction":
            out[parts] += held / held.sum()
        else:
            out[parts[np.argmax(held)]] += 1
    return out


def attribute_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), sections: str = "lines", rule: str = "majority", separator: str = "\n", vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(id, field, section, first_byte, n_bytes, n_tokens, doc_tokens): a row for each field, and with ``sections="lines"`` for each of its lines."""
    if rule not in ("majority", "start", "fraction") or sections not in ("lines", "fields"):
        raise ValueError((rule, sections))
    with open(vocabulary, "rb") as f:  # a file of the driver; executors get its bytes
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    bounded_batches(docs.sparkSession)
    made: list[Encoder] = []
    names, glue = list(fields), separator.encode()

    def run(batches):
        if not made:
            made.append(Encoder(shared.value))
        for b in batches:
            parts = [text_bytes(b.column(1 + i)) for i in range(len(names))]
            ids, out = b.column(0), []
            for i in range(b.num_rows):
                pieces = [buf[at[i] : at[i + 1]].tobytes() for buf, at in parts]
                whole = glue.join(pieces)
                if not whole:
                    continue
                cuts, labels = [], []
                edge = 0
                for k, piece in enumerate(pieces):
                    end = edge + len(piece) + (len(glue) if k + 1 < len(pieces) else 0)
                    breaks = (np.flatnonzero(np.frombuffer(piece, np.uint8) == 10) + edge + 1).tolist() if sections == "lines" else []
                    own = [x for x in breaks if x < edge + len(piece)] + [end]
                    cuts += own
                    labels += [(names[k], s) for s in range(len(own))]
                    edge = end
                cuts = np.array(cuts)
                ends = made[0].ends(whole.decode("utf-8", "replace"))
                got = allocate(ends, cuts, rule)
                starts = np.concatenate([[0], cuts[:-1]])
                out.append((i, labels, starts, cuts - starts, got, len(ends)))
                if sum(len(x[1]) for x in out) > 50_000:
                    yield _batch(ids, out)
                    out = []
            if out:
                yield _batch(ids, out)

    cols = [docs[id_col], *(docs[c].cast("string") for c in names)]
    kind = dict(docs.dtypes)[id_col]
    return docs.select(*cols).toDF("id", *(f"f{i}" for i in range(len(names)))).mapInArrow(run, f"id {kind}, field string, section long, first_byte long, n_bytes long, n_tokens double, doc_tokens long").withColumnRenamed("id", id_col)


def _batch(ids, out) -> pa.RecordBatch:
    sizes = [len(x[1]) for x in out]
    rows = pa.array(np.repeat([x[0] for x in out], sizes))
    cat = lambda k: pa.array(np.concatenate([x[k] for x in out]))
    return pa.RecordBatch.from_arrays([pc.take(ids, rows), pa.array([l[0] for x in out for l in x[1]]), pa.array([l[1] for x in out for l in x[1]], pa.int64()), cat(2), cat(3), cat(4), pa.array(np.repeat([x[5] for x in out], sizes), pa.int64())],
                                      names=["id", "field", "section", "first_byte", "n_bytes", "n_tokens", "doc_tokens"])
