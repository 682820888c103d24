"""Fill-in-middle over piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that never change: its
text (0) and the sentinels. Cutting splits descriptors, an arrangement permutes them, and the
inverse permutation restores the document; hashes stream the descriptors, so text is copied only
where an output is asked for. Cuts lie between units, `[A-Za-z]+|[^A-Za-z]`.

Rows: a null or empty text has no units and stays plain; a text that holds a sentinel stays plain; a null
doc_id takes part as the empty string; repeated rows are each answered, alike; an empty table gives no rows.
Work and memory are linear in one text, whatever its length. Other columns pass through; `fim` and `restored` are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import table, with_text_columns

#: Buffers 1, 2, 3; buffer 0 is the text.
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Places in the output of prefix, middle, suffix (0, 1, 2) and of the sentinels (3, 4, 5).
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Bytes that are looked at together.
BLOCK = 1 << 20

Piece = tuple[int, int, int]


def unit_starts(data: bytes):
    """(offset, marks) of blocks of UTF-8; a mark is where a unit starts: no continuation byte, and no letter after a letter."""
    before = False
    for a in range(0, len(data), BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - a), a)
        letter = ((part | 32) - np.uint8(97)) < 26
        follows = np.concatenate([[before], letter[:-1]])
        before = letter[-1]
        yield a, ((part & 0xC0) != 0x80) & ~(letter & follows)


def unit_places(data: bytes, choose) -> tuple[int, list[int]]:
    """The number n of units, and the byte offsets of the units that choose(n) names (n itself: the end)."""
    blocks = [(a, int(marks.sum())) for a, marks in unit_starts(data)]
    total = sum(n for _, n in blocks)
    wanted, found, past = choose(total), {total: len(data)}, 0
    if any(k not in found for k in wanted):
        for (_, n), (a, marks) in zip(blocks, unit_starts(data)):
            here = [k for k in wanted if past <= k < past + n]
            if here:
                found.update(zip(here, (a + np.flatnonzero(marks)[np.array(here) - past]).tolist()))
            past += n
    return total, [found[k] for k in wanted]


def cut(pieces: list[Piece], at: list[int]) -> list[Piece]:
    """The descriptors split at rising offsets of what they describe; one piece between each two offsets, empty ones too."""
    out, begins, rest = [], 0, list(at)
    for buffer, start, length in pieces:
        while rest and rest[0] <= begins + length:
            head = rest.pop(0) - begins
            out.append((buffer, start, head))
            begins, start, length = begins + head, start + head, length - head
        out.append((buffer, start, length))
        begins += length
    return out


def arrange(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[i] for i in order]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def stream(pieces: list[Piece], text: bytes):
    """What the descriptors describe, as views of the buffers."""
    views = [memoryview(b) for b in (text, *SENTINELS)]
    return (views[b][s : s + n] for b, s, n in pieces)


def digest(pieces: list[Piece], text: bytes) -> str:
    out = hashlib.sha256()
    for part in stream(pieces, text):
        out.update(part)
    return out.hexdigest()


def code_points(data: bytes, start: int, length: int) -> int:
    return sum(int(((np.frombuffer(data, np.uint8, min(BLOCK, start + length - a), a) & 0xC0) != 0x80).sum()) for a in range(start, start + length, BLOCK))


def transform(text: bytes, doc_id, seed=SEED, plain_from=PLAIN_FROM, spm_below=SPM_BELOW) -> tuple[int, str, list[Piece]]:
    """(units, form, descriptors of the output) of one document."""
    named = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(named[i : i + 8], 16) for i in range(0, 32, 8)]
    n, places = unit_places(text, lambda n: sorted(x % (n + 1) for x in h[:2]))
    whole = [(0, 0, len(text))]
    if not text or h[2] % 100 >= plain_from or any(s in text for s in SENTINELS):
        return n, "plain", whole
    form = "spm" if h[3] % 100 < spm_below else "psm"
    marks = [(k + 1, 0, len(s)) for k, s in enumerate(SENTINELS)]
    return n, form, arrange(cut(whole, places) + marks, ORDERS[form])


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that give its text: cut at the sentinels, then put back in order.

    No sentinel can begin or end inside text and another one, so the first of each is the one that was set.
    """
    whole = [(0, 0, len(output))]
    if form == "plain":
        return whole
    order, at, edges = ORDERS[form], 0, []
    for k in order:
        if k >= 3:
            at = output.index(SENTINELS[k - 3], at)
            edges += [at, at + len(SENTINELS[k - 3])]
            at = edges[-1]
    return arrange(cut(whole, edges)[1:], inverse(order))[:3]


FIM = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, pieces: array<struct<buffer: int, start: bigint, length: bigint>>, output: string, output_sha256: string>"


def fill_in_middle(docs: DataFrame, seed=SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """`docs` with `fim`: units, form, code points of prefix and middle (null if plain), descriptors in bytes, the output and its hash."""

    def one(text, doc_id):
        data = (text or "").encode("utf-8", "surrogatepass")
        n, form, pieces = transform(data, doc_id, seed, plain_from, spm_below)
        chars = (None, None)
        if form != "plain":
            own = arrange(pieces, inverse(ORDERS[form]))
            chars = tuple(code_points(data, s, size) for _, s, size in own[:2])
        return {
            "n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1],
            "pieces": [dict(zip(("buffer", "start", "length"), p)) for p in pieces],
            "output": b"".join(stream(pieces, data)).decode("utf-8", "surrogatepass"), "output_sha256": digest(pieces, data),
        }

    return with_text_columns(docs, ["text", "doc_id"], f"fim {FIM}", lambda: lambda texts, ids: [list(map(one, texts, ids))])


def restore(rows: DataFrame) -> DataFrame:
    """Rows of `fim` with `restored`: the text that is rebuilt from output and form alone, and its hash."""

    def one(fim):
        data = fim["output"].encode("utf-8", "surrogatepass")
        pieces = restored(data, fim["form"])
        return {"text": b"".join(stream(pieces, data)).decode("utf-8", "surrogatepass"), "sha256": digest(pieces, data)}

    return with_text_columns(rows, "fim", "restored struct<text: string, sha256: string>", lambda: lambda fims: [list(map(one, fims))])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256", F.col("restored.sha256").alias("restored_sha256"))


ORACLE_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS d
  FROM u),
f AS (
  SELECT doc_id, n, t,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
