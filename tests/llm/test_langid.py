from scrollmill.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs if got[r.doc_id].held_out]
    assert len(got) == len(docs) and 200 < len(held) < 500
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) < 0.02 * len(got)


def test_odd_rows_and_passed_columns(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the house and the garden are big", "en"), ("das haus und der garten sind gross", "de"), (None, "en"), ("", None), ("12 !!", "de"), ("\u00bd \u00b2", "en"), ("the garden and the house", None), ("das haus und der garten", "de")] * 4)] + [(None, "the garden is big " * 5000, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.with_language(docs, langid.dictionaries(docs)).collect()
    pred = {(r.text or "")[:30]: r.lang_pred for r in out}
    assert pred[""] == pred["12 !!"] == pred["\u00bd \u00b2"] == "und" and pred["the garden and the house"] == "en" and pred["das haus und der garten"] == "de"
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()} >= {"das haus und der garten"} and not {r.text for r in kept.collect()} & {None, "", "12 !!"}
    assert langid.drop_rejected(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.with_language(docs, {}).collect()} == {"und"}


def test_narrow_margin_is_rejected():
    c = langid.Classifier({"a": b"one two three four", "b": b"one two three four"})
    assert c.predict("one two three")[3] and c.predict("one two three")[0] == "a"


def test_copies_do_not_shrink_a_dictionary(spark):
    texts = [f"{chr(97 + i) * 3} text" for i in range(20)]
    docs = spark.createDataFrame([(t, "en") for t in texts * 50], "text string, lang string")
    raw = langid.dictionaries(docs, pieces=20)["en"].decode()
    assert [t for t in texts if t not in raw] == []


def test_query_matches_plain_compression(spark, sf_dir):
    """Every prediction again, with a compressor made anew for each block and language."""
    import unicodedata

    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = langid.dictionaries(langid.learnable(docs))

    def sizes(text):
        letters = "".join(c if (c.isalnum() and unicodedata.category(c) != "Nd") else " " for c in text)
        folded = " ".join(letters.split()).lower()
        out = {}
        for lang, data in raw.items():
            shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            out[lang] = sum(len(press.compress(folded[a : a + langid.BLOCK].encode())) for a in range(0, len(folded), langid.BLOCK))
        return folded, out

    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf_dir).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    assert len(rows) > 100
    for r in rows[::2]:
        folded, found = sizes(r.text or "")
        if not any(c.isalpha() for c in folded):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        best = min(found, key=lambda k: (found[k], k))
        second = min(n for k, n in found.items() if k != best)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].rejected == ((second - found[best]) / second < langid.MIN_MARGIN)
