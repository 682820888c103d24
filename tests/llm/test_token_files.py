import io
import zlib

import numpy as np
import pytest

from scrollmill.llm import token_files as tf
from scrollmill.llm.common import new_folder

TEXTS = ["", "plain words here", " lead", "a  b   c", "tab\t x\n y \n z", "end ", "a  b  c", "x\x1c y", "<|endoftext|> is here <|endoftext|>", "it's 'll 've  n't", "日本 語 \n\n 文", "!!! ??? ...  $$", "\n", " ", "   ", "a \r\n b", "12 34,56 7"]


def direct(text):
    return tf.encoder(tf.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_same_ids_as_whole_texts(spark, sf_dir):
    enc = tf.encoder(tf.default_tokenizer())
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [direct(t) for t in texts]


def test_round_trip_with_nulls_ties_and_extra_columns(spark):
    rows = [(i * 3 - 5, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (4, None, 2), (4, "again", 2), (4, "again", 2), (2**53 + 1, "large id", 1)]
    folder = new_folder(spark, "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    got = tf.read_token_files(tf.write_token_files(docs, folder, tf.default_tokenizer()), folder).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, expected = 0, []
    for doc_id, text, _ in order:
        ids = [*direct(text), 0]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_empty_table(spark):
    folder = new_folder(spark, "t")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_token_files(tf.write_token_files(docs, folder, tf.default_tokenizer()), folder).count() == 0


def test_reader_fetches_one_document_and_notices_damage():
    out = io.BytesIO()
    docs = [(i, np.arange(i * 50, dtype="<u2").tobytes()) for i in range(6)]
    tf.write_frames(out, iter(docs), np.dtype("<u2"), 50257, 0, 3)
    data = out.getvalue()
    reader = tf.FrameReader(io.BytesIO(data))
    assert reader.tokens(3).tolist() == [*range(150), 0]
    broken = bytearray(data)
    broken[int(reader.offset[4]) + 14] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        tf.FrameReader(io.BytesIO(bytes(broken))).tokens(3)
    assert tf.FrameReader(io.BytesIO(bytes(broken))).tokens(5).tolist() == [*range(250), 0]
