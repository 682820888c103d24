"""Merging batches: messages, conversations, identity with the store, evidence, upserts, pruning."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollmill.functions.ids import UNIT, content_hash, conversation_id, message_id, stable_id
from scrollmill.functions.urls import aliases
from scrollmill.operators.batch import STORE, Batch, Store, cut, cut_all, empty, shaped
from scrollmill.operators.status import roll_up_status
from scrollmill.operators.windows import keep_first

LISTS = ("upstream_ids", "attachments", "citations", "media")


def merge_key() -> Column:
    """A hash of what makes two messages one: upstream id (or else the time), role, text and thinking."""
    none = F.lit("")
    text = [F.coalesce(F.col(c), none) for c in ("role", "text", "thinking")]
    upstream = F.coalesce(F.col("upstream_id"), none)
    return F.when(upstream != "", F.sha2(F.concat_ws(UNIT, F.lit("u"), upstream, *text), 256)).otherwise(F.sha2(F.concat_ws(UNIT, F.lit("t"), text[0], F.coalesce(F.col("created_at"), none), *text[1:]), 256))


def merge_messages(rows: DataFrame, by: str = "conv_key", order: str = "ord") -> DataFrame:
    """One row per (conversation, merge key): the first body at the first place, metadata united in order.

    The last model id that is not empty wins, the latest updated_at, and lists are joined in order without repeats.
    The shuffle key is a hash, not the text.
    """
    keyed = rows.withColumn("_key", merge_key())
    seq = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(c, F.expr("cast(array() as array<string>)")).alias("v")))), lambda s: s["v"])))
    first = [F.min_by(F.struct(*[c for c in rows.columns if c not in (by, order, "updated_at", "model_id", *LISTS)]), order).alias("first")]
    merged = keyed.groupBy(by, "_key").agg(
        F.min(order).alias(order),
        *first,
        F.max(F.nullif(F.col("updated_at"), F.lit(""))).alias("updated_at"),
        F.max_by("model_id", F.when(F.col("model_id") != "", F.col(order))).alias("model_id"),
        *[seq(F.col(c)).alias(c) for c in LISTS],
    )
    return merged.select(by, order, "first.*", "updated_at", "model_id", *LISTS).select(*rows.columns)


def with_identity(batch: Batch) -> DataFrame:
    """Conversations with signature, url, message keys, own id and the key that joins rows of one batch."""
    keys = batch.messages.groupBy("conv_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("upstream_id", F.concat(F.coalesce("text", F.lit("")), F.lit(UNIT), F.coalesce("thinking", F.lit("")))).alias("k")))), lambda s: s["k"]).alias("message_keys"))
    rows = batch.conversations.join(keys, "conv_key", "left").withColumn("message_keys", F.coalesce("message_keys", F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("signature", F.nullif(F.col("metadata")["captureSignature"], F.lit(""))).withColumn("url", F.nullif(F.col("metadata")["url"], F.lit("")))
    rows = rows.withColumn("own_id", conversation_id())
    key = F.when(F.col("signature").isNotNull(), F.concat_ws(UNIT, F.lit("s"), "source_id", "signature")).when(F.length("upstream_id") > 0, F.concat_ws(UNIT, F.lit("u"), "source_id", "upstream_id")).otherwise(F.concat_ws(UNIT, F.lit("i"), "own_id"))
    return rows.withColumn("batch_key", F.sha2(key, 256)).drop("message_keys")


def merge_batch_conversations(batch: Batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, evidence) with one conversation per batch key; earlier rows (by conv_key) win.

    Times are the earliest and latest, metadata of earlier rows is kept over later ones.
    """
    rows = with_identity(batch)
    named = F.map_from_entries(F.flatten(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("conv_key", F.map_entries(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))).alias("e"))))), lambda s: s["e"])))
    body = ["source_id", "source_label", "upstream_id", "signature", "url", "title", "own_id"]
    merged = rows.groupBy("batch_key").agg(F.min("conv_key").alias("conv_key"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"), F.min_by(F.struct(*body), "conv_key").alias("b"), named.alias("metadata"))
    conversations = merged.select("batch_key", "conv_key", "b.*", "started_at", "updated_at", "metadata")
    link = rows.select("conv_key", "batch_key")
    placed = batch.messages.join(link, "conv_key")
    placed = placed.withColumn("ord", F.struct(F.lit(1).alias("side"), F.col("conv_key").alias("conv"), F.col("ord").alias("at"))).drop("conv_key")
    evidence = keep_first(batch.evidence.join(link, "conv_key").withColumn("_h", F.sha2(F.concat_ws(UNIT, "uri", "content"), 256)), ["batch_key", "_h"], ["conv_key", "ord"]).drop("_h", "conv_key")
    return conversations, placed, evidence


#: Buckets of the keys that a store keeps; a row of `KEYS` for each signature, upstream id and alias of a conversation.
KEY_BUCKETS = 256
KEYS = "bucket int, source_id string, kind string, key string, id string, updated_at string"


def key_rows(rows: DataFrame, *carried: str) -> DataFrame:
    """(bucket, source_id, kind, key, n, carried) of conversations: s by signature, u by upstream id, a by alias (n: its place)."""
    one = lambda kind, key, at: F.struct(F.lit(kind).alias("kind"), key.alias("key"), at.cast("int").alias("n"))
    exact = F.array(one("s", F.col("signature"), F.lit(0)), one("u", F.nullif(F.col("upstream_id"), F.lit("")), F.lit(0)))
    alias = F.transform(aliases(), lambda x, i: one("a", x, i))
    out = rows.select("source_id", *carried, F.explode(F.concat(exact, F.coalesce(alias, F.array().cast("array<struct<kind:string,key:string,n:int>>")))).alias("k")).select("source_id", *carried, "k.*").filter("key is not null")
    return out.select(F.pmod(F.xxhash64("source_id", "kind", "key"), F.lit(KEY_BUCKETS)).cast("int").alias("bucket"), "source_id", "kind", "key", "n", *carried)


def stored_keys(conversations: DataFrame) -> DataFrame:
    """KEYS of stored conversations."""
    return key_rows(conversations, "id", "updated_at").select("bucket", "source_id", "kind", "key", "id", "updated_at")


def probe(conversations: DataFrame, keys: DataFrame) -> DataFrame:
    """(batch_key, kind, n, id, updated_at): the stored conversations that share a key with one of a batch.

    The keys' table is read where the batch's keys lie, by bucket, and the rest of a bucket is dropped before anything is grouped.
    """
    own = cut(key_rows(conversations, "batch_key"), "keys")
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # KEY_BUCKETS at most
    if len(touched) < KEY_BUCKETS:
        keys = keys.filter(F.col("bucket").isin(touched))
    return own.join(keys, ["bucket", "source_id", "kind", "key"]).select("batch_key", "kind", "n", "id", "updated_at")


def resolve_ids(conversations: DataFrame, store: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(batch_key, conversation_id, match): the stored id by signature, else upstream id, else alias, else the own id.

    Of several stored rows the newest (updated_at, then id) is taken, of aliases the first that meets one; null keys never meet.
    """
    hits = probe(conversations, stored_keys(store)) if hits is None else hits
    best = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("id")), F.when(F.col("kind") == kind, F.struct(-F.col("n"), "updated_at", "id")))
    found = hits.groupBy("batch_key").agg(best("s").alias("h1"), best("u").alias("h2"), best("a").alias("h3"))
    out = conversations.select("batch_key", "own_id").join(found, "batch_key", "left")
    match = F.when(F.col("h1").isNotNull(), "signature").when(F.col("h2").isNotNull(), "upstream").when(F.col("h3").isNotNull(), "alias").otherwise("new")
    return out.select("batch_key", F.coalesce("h1", "h2", "h3", "own_id").alias("conversation_id"), match.alias("match"))


def duplicate_ids(hits: DataFrame, resolved: DataFrame) -> DataFrame:
    """(batch_key, conversation_id, duplicate_id, exact): other stored rows of the same signature, upstream id or alias.

    Exact ones share signature or upstream id; chains are not followed further.
    """
    every = hits.join(resolved, "batch_key").filter(F.col("id") != F.col("conversation_id"))
    return every.groupBy("batch_key", "conversation_id", F.col("id").alias("duplicate_id")).agg(F.bool_or(F.col("kind") != "a").alias("exact"))


def dedup_evidence(rows: DataFrame) -> DataFrame:
    """One row per (source, content), the first by (uri); only hashes are shuffled to choose it. Ids do not depend on paths."""
    hashed = rows.withColumn("content_hash", content_hash("content")).withColumn("evidence_id", stable_id("raw", "source_id", "content_hash"))
    return keep_first(hashed, ["source_id", "content_hash"], ["uri"])


def link_evidence(messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Messages with evidence_id, by uri inside a conversation."""
    side = evidence.select("batch_key", F.col("uri").alias("evidence_uri"), "evidence_id").groupBy("batch_key", "evidence_uri").agg(F.min("evidence_id").alias("evidence_id"))
    return messages.join(side, ["batch_key", "evidence_uri"], "left")


def upsert_diagnostics(old: DataFrame, new: DataFrame, at: str, clear_sources: DataFrame | None = None) -> DataFrame:
    """Diagnostics by content id, the newest kept; sources in `clear_sources` lose their old ones first."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    fresh = new.withColumn("id", stable_id("diag", *[none(c) for c in ("source_id", "severity", "code", "message", "evidence_ref")])).withColumn("created_at", F.lit(at))
    fresh = shaped(fresh, STORE["diagnostics"])
    if clear_sources is not None:
        old = old.join(clear_sources, "source_id", "left_anti")
    return keep_first(old.unionByName(fresh), ["id"], [F.col("created_at").desc()])


def missing(store: DataFrame, keep: DataFrame, sources: DataFrame) -> DataFrame:
    """(id) of the stored conversations of `sources` that are not in `keep` (id)."""
    return store.join(sources, "source_id", "left_semi").join(keep, "id", "left_anti").select("id")


@dataclass
class Change:
    """What a merge does to a store: whole rows of the conversations it touches, ids that go, new evidence and diagnostics,
    sources whose old evidence and diagnostics go, and the status after it."""

    conversations: DataFrame
    messages: DataFrame
    gone: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame
    cleared: DataFrame
    status: DataFrame

    @property
    def keys(self) -> DataFrame:
        return stored_keys(self.conversations)


def merge_change(store: Store, batch: Batch, scope: str = "partial", at: str = "1970-01-01T00:00:00.000Z") -> Change:
    """What merging a batch changes; of the store only rows of conversations that the batch meets are read whole.

    full: the sources of the batch lose what it does not hold (unless it has an error diagnostic), their evidence and
    diagnostics. partial: messages of the stored conversation and its exact duplicates come first, times widen.
    Rows stored under another id of the same conversation are removed.
    """
    if scope not in ("full", "partial"):
        raise ValueError("scope is full or partial")
    batch = Batch(**cut_all(**{f.name: getattr(batch, f.name) for f in fields(Batch)}))
    conversations, incoming, evidence = merge_batch_conversations(batch)
    conversations = cut(conversations, "incoming")
    hits = cut(probe(conversations, stored_keys(store.conversations) if store.keys is None else store.keys), "hits")
    conversations = cut(conversations.join(resolve_ids(conversations, store.conversations, hits), "batch_key"), "resolved")
    target = conversations.select("batch_key", "conversation_id")
    doubles = duplicate_ids(hits, target)
    evidence = evidence.withColumn("content_hash", content_hash("content")).withColumn("evidence_id", stable_id("raw", "source_id", "content_hash"))
    both = cut_all(doubles=doubles, evidence=evidence)
    doubles, evidence = both["doubles"], both["evidence"]
    # Two rows of one batch may resolve to one stored id: the later (by conv_key) gives the body.
    fresh = link_evidence(incoming, evidence).join(target, "batch_key").drop("batch_key", "evidence_uri")
    cols = [c for c in fresh.columns if c not in ("conversation_id", "ord")]
    if scope == "partial":
        exact = target.select("conversation_id", F.col("conversation_id").alias("old_id")).union(doubles.filter("exact").select("conversation_id", F.col("duplicate_id").alias("old_id"))).distinct()
        held = store.messages.withColumnRenamed("conversation_id", "old_id").join(exact, "old_id")
        held = held.withColumn("ord", F.struct(F.lit(0).alias("side"), F.concat(F.col("created_at"), F.lit(UNIT), F.col("message_id")).alias("conv"), F.lit(0).cast("long").alias("at"))).withColumn("evidence_id", F.lit(None).cast("string"))
        fresh = fresh.select("conversation_id", "ord", *cols).unionByName(held.select("conversation_id", "ord", *cols))
        times = store.conversations.select(F.col("id").alias("old_id"), F.col("started_at").alias("s"), F.col("updated_at").alias("u")).join(exact, "old_id").groupBy("conversation_id").agg(F.min("s").alias("s"), F.max("u").alias("u"))
    merged = merge_messages(fresh.select("conversation_id", "ord", *cols), "conversation_id")
    body = conversations.groupBy("conversation_id").agg(F.max_by(F.struct("source_id", "source_label", "upstream_id", "signature", "url", "title", "metadata"), "conv_key").alias("b"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"))
    body = body.select("conversation_id", "b.*", "started_at", "updated_at")
    if scope == "partial":
        body = body.join(times, "conversation_id", "left").withColumn("started_at", F.least("started_at", "s")).withColumn("updated_at", F.greatest("updated_at", "u")).drop("s", "u")
    index = (F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")) - 1).alias("idx")
    names = body.select("conversation_id", F.coalesce(F.nullif("upstream_id", F.lit("")), "title").alias("conv_upstream"))
    messages = merged.withColumn("idx", index).join(names, "conversation_id").withColumn("message_id", message_id())
    messages = cut(shaped(keep_first(messages, ["message_id"], ["idx"]), STORE["messages"]), "messages")  # equal ids: the first stays
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    refs = evidence.join(target, "batch_key").groupBy("conversation_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_refs"))
    rows = body.join(counts, "conversation_id", "left").join(refs, "conversation_id", "left").withColumnRenamed("conversation_id", "id")
    rows = shaped(rows.withColumn("message_count", F.coalesce("message_count", F.lit(0))).withColumn("evidence_refs", F.coalesce("evidence_refs", F.expr("cast(array() as array<string>)"))), STORE["conversations"])
    ids = conversations.select(F.col("conversation_id").alias("id")).distinct()
    gone = doubles.select(F.col("duplicate_id").alias("id")).join(ids, "id", "left_anti")
    sources = batch.conversations.select("source_id").union(batch.diagnostics.select("source_id")).union(batch.facts.select("source_id")).filter("source_id is not null").distinct()
    cleared = sources.limit(0)
    if scope == "full":
        failed = batch.diagnostics.filter("severity = 'error'").select("source_id").distinct()
        gone, cleared = gone.union(missing(store.conversations, ids, sources.join(failed, "source_id", "left_anti"))), sources
    old_evidence = store.evidence if scope == "partial" else store.evidence.join(cleared, "source_id", "left_anti")
    # Only what the store holds of the batch's own sources is looked at.
    old_evidence = old_evidence.join(F.broadcast(sources), "source_id", "left_semi")  # a row for each source
    new_evidence = shaped(keep_first(evidence, ["evidence_id"], ["uri"]).withColumn("created_at", F.lit(at)), STORE["evidence"]).join(old_evidence.select("evidence_id"), "evidence_id", "left_anti")
    told = upsert_diagnostics(empty(store.status.sparkSession, STORE["diagnostics"]), batch.diagnostics, at)
    done = cut_all(rows=rows, gone=gone.distinct(), new_evidence=new_evidence, told=told, cleared=cleared)
    change = Change(done["rows"], messages, done["gone"], done["new_evidence"], done["told"], done["cleared"], store.status)
    change.status = roll_up_status(store.status, store, batch, change, scope, at)
    return change


def apply_change(store: Store, change: Change) -> Store:
    """A store after a change: untouched rows stay as they are."""
    touched = change.conversations.select("id").union(change.gone).distinct()
    return Store(
        store.conversations.join(touched, "id", "left_anti").unionByName(change.conversations),
        store.messages.join(touched.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti").unionByName(change.messages),
        store.evidence.join(change.cleared, "source_id", "left_anti").unionByName(change.evidence),
        keep_first(store.diagnostics.join(change.cleared, "source_id", "left_anti").unionByName(change.diagnostics), ["id"], [F.col("created_at").desc()]),
        change.status,
    )


def together(batches: list[Batch]) -> Batch:
    """Batches of several sources as one, to be merged in one plan; sessions of different batches never meet by their keys alone."""
    out = None
    for n, batch in enumerate(batches):
        own = {f.name: getattr(batch, f.name) for f in fields(Batch)}
        for name in ("conversations", "messages", "evidence"):
            own[name] = own[name].withColumn("conv_key", F.concat(F.lit(f"{n:04d}{UNIT}"), "conv_key"))
        out = Batch(**own) if out is None else out.union(Batch(**own))
    return out


def merge_batch(store: Store, batch: Batch, scope: str = "partial", at: str = "1970-01-01T00:00:00.000Z") -> Store:
    """A new store with a batch merged in; see `merge_change`."""
    return apply_change(store, merge_change(store, batch, scope, at))
