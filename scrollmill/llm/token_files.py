"""Token-ID files: independent zstandard frames with a trailing seek table.

File layout (all integers little-endian):

* skippable frame 0x184D2A50: JSON header (id width, vocabulary size, end id);
* one zstandard frame per document, ascending doc_id, holding its ids (uint16 where the
  vocabulary fits, else uint32) and the end id;
* skippable frame 0x184D2A51: document index (presence byte, int64 doc_id, uint32 ids);
* skippable frame 0x184D2A5E: the seek table of the public seekable format, with the
  low 32 bits of XXH64 of each frame's content, so that a reader fetches one document.

Rows: a null or empty text is a document with the end id alone. Rows with equal doc_id stay
separate documents, ordered by the first characters of their texts, then by a hash; a null doc_id sorts first. An empty table gives no files
and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import new_folder, open_store, put_file, ranges, release

HEADER, INDEX, SEEK = 0x184D2A50, 0x184D2A51, 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
#: A space before another character than white space always starts a piece of the byte-level splitter, which never spans it.
GAP = re.compile(r" (?=\S)")
#: A space that does not, in RE2's syntax.
NO_GAP = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: Bytes of words and ids that an encoder remembers, and of text that it takes at once (unless one text is longer).
CACHE_BYTES, SLICE_BYTES = 80_000_000, 5_000_000
#: Chunks that are joined to one text.
LEARN = 20_000
#: Rows of equal doc_id are ordered by so many characters, then by a hash; rows alike are dealt to so many ranges at most.
HEAD_CHARS, SPREAD = 64, 1024
_encoders: dict = {}


class ChunkEncoder:
    """Ids of whole texts as bytes. A text is cut only where the splitter cuts too, so each distinct chunk is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 65536 else np.dtype("<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.cuttable = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
        self.whole = "|".join([NO_GAP, *map(re.escape, self.added)])
        #: A byte-level token has one character for each of its bytes.
        self.n_bytes = np.zeros(self.vocab, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """An empty memory: numbers of first chunks and of chunks after a space, and where each number's ids lie in `flat`."""
        self.heads: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.size, self.uses, self.count, self.bytes = *np.zeros((3, 1 << 14), np.int32), 0, 0

    def _trim(self) -> None:
        """Forget chunks that few slices have held, until half the memory is free."""
        heads, known, flat, start, size, uses, least = self.heads, self.known, self.flat, self.start, self.size, self.uses, 2
        while (uses >= least).sum() * self.bytes > self.count * CACHE_BYTES // 2:
            least *= 2
        self._forget()
        for old, new in ((heads, self.heads), (known, self.known)):
            chunks = [c for c, k in old.items() if uses[k] >= least]
            at = np.array([old[c] for c in chunks], np.int64)
            self._store(new, chunks, flat[ranges(start[at], size[at])], size[at])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self._ids(texts)]

    def _store(self, table: dict[str, int], chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(chunks) > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))
        new = slice(self.count, self.count + len(chunks))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        table.update(zip(chunks, range(self.count, self.count + len(chunks))))
        self.used, self.count = self.used + len(ids), self.count + len(chunks)
        self.bytes += sum(map(len, chunks)) + 200 * len(chunks) + ids.nbytes

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that follow a space. They are joined to texts, whose ids are cut at the chunks' bytes."""
        for a in range(0, len(chunks), LEARN):
            some = chunks[a : a + LEARN]
            ids = np.array(self._ids([" " + " ".join(some)])[0], self.dtype)
            ends = np.cumsum(np.array([len(c) if c.isascii() else len(c.encode()) for c in some]) + 1)
            self._store(self.known, some, ids, np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1, prepend=0))

    def _learn_heads(self, chunks: list[str]) -> None:
        found = self._ids(chunks)
        self._store(self.heads, chunks, np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found], np.int64))

    def _assemble(self, chunks, counts: np.ndarray) -> list[bytes]:
        """Ids of texts from an Arrow array of their chunks, text after text, `counts` of each."""
        first = np.cumsum(counts) - counts
        coded = chunks.dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = [words[i] for i in code[first]]
        self._learn_heads(list({h for h in heads if h not in self.heads}))
        later = np.ones(len(code), bool)
        later[first] = False
        used = np.zeros(len(words), bool)
        used[code[later]] = True
        number = np.array([*map(self.known.get, words, repeat(-1))], np.int32)
        new = np.flatnonzero(used & (number < 0))
        number[new] = np.arange(self.count, self.count + len(new))
        self._learn([words[i] for i in new.tolist()])
        number = number[code]
        number[first] = [*map(self.heads.__getitem__, heads)]
        self.uses += np.bincount(number, minlength=len(self.uses)) > 0
        ids = self.flat[ranges(self.start[number], self.size[number])]
        ends = np.cumsum(np.add.reduceat(self.size[number], first, dtype=np.int64)).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def encode(self, texts) -> list[bytes]:
        """Packed ids of texts without nulls, a list or an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        if not self.cuttable:
            return self._pack(texts.to_pylist())
        if self.bytes > CACHE_BYTES:
            self._trim()
        # An added token's text is taken out before splitting, so such a text stays whole.
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        plain, out = np.flatnonzero(~odd), np.empty(len(texts), object)
        if len(plain):
            cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
            out[plain] = self._assemble(cut.flatten(), np.diff(cut.offsets.to_numpy()))
        if odd.any():
            cut = [[t] if any(a in t for a in self.added) else GAP.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            out[odd] = self._assemble(pa.array([c for chunks in cut for c in chunks], pa.string()), np.array([len(c) for c in cut]))
        return out.tolist()


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of a text column, of `limit` bytes at most unless one row is longer."""
    import pyarrow.compute as pc

    sizes, a, held = pc.fill_null(pc.binary_length(column), 0).to_pylist(), 0, 0
    for b, n in enumerate(sizes):
        if held and held + n > limit:
            yield a, b
            a, held = b, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_frames(out, docs: Iterator[tuple[int | None, bytes]], dtype: np.dtype, vocab: int, end_id: int, level: int) -> tuple[int, int]:
    """Write one file; documents in the order given. Returns (documents, ids)."""
    head = json.dumps({"width": dtype.itemsize, "vocab": vocab, "end_id": end_id}).encode()
    out.write(struct.pack("<II", HEADER, len(head)) + head)
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    seek, present, ids, counts = [(8 + len(head), 0, 0)], [], [], []
    end = np.array([end_id], dtype).tobytes()
    for doc_id, packed in docs:
        raw = packed + end
        frame = press.compress(raw)
        out.write(frame)
        seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        present.append(doc_id is not None)
        ids.append(doc_id or 0)
        counts.append(len(raw) // dtype.itemsize)
    index = struct.pack("<I", len(ids)) + np.array(present, "u1").tobytes() + np.array(ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    out.write(struct.pack("<II", INDEX, len(index)) + index)
    seek.append((8 + len(index), 0, 0))
    table = np.array(seek, "<u4").tobytes()
    out.write(struct.pack("<II", SEEK, len(table) + 9) + table + struct.pack("<IBI", len(seek), 0x80, SEEK_FOOTER))
    return len(ids), int(sum(counts))


class FrameReader:
    """Random access to the documents of one file: only frames that are asked for are read and decompressed."""

    def __init__(self, source):
        self.source = source
        self.unpress = zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(start, 8)) != (SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        if self.offset[-1] != start:
            raise ValueError("frame sizes do not add up to the file's size")
        head = self._at(0, int(self.seek[0, 0]))
        if struct.unpack("<I", head[:4])[0] != HEADER:
            raise ValueError("no header frame")
        self.head = json.loads(head[8:])
        self.dtype = np.dtype("<u2" if self.head["width"] == 2 else "<u4")
        index = self._at(int(self.offset[n - 1]), int(self.seek[n - 1, 0]))[8:]
        self.n = struct.unpack("<I", index[:4])[0]
        if self.n != n - 2:
            raise ValueError("the index and the seek table differ in documents")
        self.present = np.frombuffer(index, "u1", self.n, 4)
        self.ids = np.frombuffer(index, "<i8", self.n, 4 + self.n)
        self.counts = np.frombuffer(index, "<u4", self.n, 4 + 9 * self.n)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document, the end id last."""
        _, size, check = self.seek[k + 1]
        raw = self.unpress.decompress(self._at(int(self.offset[k + 1]), int(self.seek[k + 1, 0])), max_output_size=int(size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        ids = np.frombuffer(raw, self.dtype)
        if len(ids) != self.counts[k]:
            raise ValueError(f"frame {k} has {len(ids)} ids, the index says {self.counts[k]}")
        return ids.astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, level: int = 3) -> DataFrame:
    """Write `docs` (doc_id, text) as files in ascending doc_id order.

    Returns the manifest: one row per file (shard, file, n_docs, n_tokens, start), where start
    is the number of ids in all files before it. Files come from contiguous ranges of doc_id,
    so the text is dealt once, and their number follows the session's shuffle partitions. Rows of one
    doc_id may lie in several files.
    """
    spark = docs.sparkSession

    def shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        k, enc = TaskContext.get().partitionId(), encoder(tokenizer)

        def rows():
            for batch in chain([first], batches):
                ids, texts = batch.columns
                for a, b in slices(texts):
                    yield from zip(ids[a:b].to_pylist(), enc.encode(texts[a:b].fill_null("")))

        found = []
        name = f"tokens-{k:06d}.zst"
        put_file(folder, name, lambda out: found.extend(write_frames(out, rows(), enc.dtype, enc.vocab, end_id, level)))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, name, *found)], names=["shard", "file", "n_docs", "n_tokens"])
        release()

    # Rows of one id are dealt by their texts, rows alike by their places.
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    order = [F.substring("text", 1, HEAD_CHARS).alias("head"), F.xxhash64("text").alias("h"), place.alias("place")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *order)
    ranged = ranged.repartitionByRange("doc_id", "head", "h", "place").sortWithinPartitions("doc_id", "head", "h").select("doc_id", "text")
    path = folder + "-manifest"
    ranged.mapInArrow(shard, "shard long, file string, n_docs long, n_tokens long").write.parquet(path)
    sizes = sorted((r.shard, r.file, r.n_docs, r.n_tokens) for r in spark.read.parquet(path).collect())  # one row a file
    starts = np.concatenate([[0], np.cumsum([r[3] for r in sizes], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(*r, starts[i]) for i, r in enumerate(sizes)], "shard long, file string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every document back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                store, path = open_store(f"{folder}/{r.file}")
                with store.open_input_file(path) as source:
                    reader = FrameReader(source)
                    starts = r.start + np.concatenate([[0], np.cumsum(reader.counts, dtype=np.int64)])[:-1]
                    crc = [zlib.crc32(reader.tokens(k).tobytes()) for k in range(reader.n)]
                    ids = pd.array(reader.ids, dtype="Int64")
                    ids[reader.present == 0] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": reader.counts.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    spark = manifest.sparkSession
    files = max(1, manifest.count())
    spread = manifest.repartition(min(files, 4 * spark.sparkContext.defaultParallelism), "file") if files > 1 else manifest
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` written as token files under the shared folder and read back."""
    from scrollmill.llm.common import table

    folder = new_folder(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_token_files(manifest, folder)
