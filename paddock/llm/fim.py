"""Fill-in-middle transformation over a piece table.

A document is a list of descriptors (buffer, start, length), in bytes, over two buffers that
never change: its text and the sentinels. Cutting splits a descriptor in two, an arrangement
is a permutation of descriptors, restoring applies the inverse permutation to the descriptors
read off an output, and digests are streamed over descriptors, so that no step copies text
but the one that writes the output.

The units are runs of ASCII letters and single other code points. Both cuts, and the form, come
from the SHA-256 of seed and document id, so a repeated run, a lost executor and any
partitioning give the same output.

Forms: ``plain`` is the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is
``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A text that holds a sentinel stays plain. No proper
end of a sentinel starts one, so an output has each sentinel exactly where it was put.

Defined results: a null text counts as empty and is plain; a null id has the digest of the seed and
an empty string; rows that repeat an id are each cut alike by their own text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import byte_values, per_batch, schema, table

# The sentinels, and how often which form is taken (per cent).
SENTINELS = (b"<P>", b"<S>", b"<M>")
FIM_PERCENT, SPM_PERCENT = 90, 20

TEXT, MARKS = 0, 1  # the buffers of a piece table
Piece = tuple[int, int, int]
_MARKS = b"".join(SENTINELS)
_P, _S, _M = ((MARKS, 3 * k, 3) for k in range(3))

#: Where prefix, middle and suffix (0, 1, 2) and the sentinels go, per form.
ORDER: dict[str, tuple] = {"psm": (_P, 0, _S, 2, _M, 1), "spm": (_S, 2, _P, 0, _M, 1)}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(_MARKS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds offset ``at``; at its border an empty piece splits off."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[k:k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise IndexError("offset beyond the pieces")

    def arrange(self, order: tuple) -> "PieceTable":
        """Pieces by number and given descriptors, in ``order``."""
        return PieceTable(self.buffers[TEXT], [self.pieces[o] if isinstance(o, int) else o for o in order])

    def views(self):
        return (self.buffers[b][s:s + n] for b, s, n in self.pieces)

    def digest(self) -> str:
        h = hashlib.sha256()
        for view in self.views():
            h.update(view)
        return h.hexdigest()

    def join(self) -> bytes:
        return b"".join(self.views())


def parse(output: bytes, form: str) -> PieceTable:
    """The pieces of an output, sentinels included, found by their sentinels alone."""
    done = PieceTable(output)
    if form == "plain":
        return done
    at, pieces = 0, []
    marks = [o for o in ORDER[form] if not isinstance(o, int)]
    for (_, start, n), after in zip(marks, [*marks[1:], None], strict=True):
        pieces.append((TEXT, at, n))
        end = len(output) if after is None else output.index(_MARKS[after[1]:after[1] + after[2]], at + n)
        pieces.append((TEXT, at + n, end - at - n))
        at = end
    return PieceTable(output, pieces)


def restored(output: bytes, form: str) -> PieceTable:
    """The text as pieces of an output: the inverse of the form's arrangement without sentinels."""
    done = parse(output, form)
    if form == "plain":
        return done
    place = {o: k for k, o in enumerate(ORDER[form]) if isinstance(o, int)}
    return done.arrange(tuple(place[k] for k in sorted(place)))


def draws(doc_id: object, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def transform(text: bytes, doc_id: object, seed: int = 1, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> tuple[int, str, PieceTable, int | None, int | None]:
    """(units, form, output as pieces, code points of the prefix and of the middle; null if plain)."""
    data = np.frombuffer(text, np.uint8)
    point = (data & 0xC0) != 0x80
    first = point.copy()
    letter = _LETTER[data]
    first[1:] &= ~(letter[1:] & letter[:-1])
    starts = np.append(np.flatnonzero(first), len(data))
    n = len(starts) - 1
    h = draws(doc_id, seed)
    done = PieceTable(text)
    if not n or h[2] % 100 >= fim_percent or any(s in text for s in SENTINELS):
        return n, "plain", done, None, None
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    a, b = (int(starts[k]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    done.cut(b)
    done.cut(a)
    return n, form, done.arrange(ORDER[form]), int(point[:a].sum()), int(point[a:b].sum())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: (id, n, form, prefix_chars, middle_chars, output, output_sha256)."""
    def make():
        def fn(batch):
            out = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                n, form, done, prefix, middle = transform(text or b"", doc, seed, fim_percent, spm_percent)
                for column, value in zip(out, (n, form, prefix, middle, done.join(), done.digest()), strict=True):
                    column.append(value)
            return [batch.column(0), *out]
        return fn

    return per_batch(docs.select(id_col, text_col), make, schema(
        docs, id_col, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"))


def restore(done: DataFrame) -> DataFrame:
    """``done`` with ``text``, rebuilt from ``output`` and ``form`` alone, and its ``restored_sha256``."""
    at = [done.columns.index(c) for c in ("output", "form")]

    def make():
        def fn(batch):
            found = [restored(o, f) for o, f in zip(byte_values(batch.column(at[0])), batch.column(at[1]).to_pylist(), strict=True)]
            return [*batch.columns, [f.join() for f in found], [f.digest() for f in found]]
        return fn

    return per_batch(done, make, T.StructType([*done.schema.fields, *T.StructType.fromDDL("text string, restored_sha256 string").fields]))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                       F.sha2("text", 256).alias("restored_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, t, len(t) AS n, {', '.join(f"CAST('0x' || x[{8 * k + 1}:{8 * k + 8}] AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS prefix, coalesce(array_to_string(t[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(t[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
