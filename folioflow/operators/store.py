"""The store's reads and writes as functions from old rows and changes to new rows.

Plain Parquet has no UPDATE, DELETE or MERGE, so each write returns the table's new rows, for the caller to write to
a new place or as a partition overwrite. Deletes cascade along schema.CASCADES by anti-joins, parents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow import schema
from folioflow.functions.text import strip
from folioflow.operators.library import distinct_names


def lookup(df: DataFrame, order: list | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values, in a stated order."""
    for c, v in equal.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df.orderBy(*order) if order else df


def newest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; with a total order the choice is always the same."""
    w = W.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The rows with columns set where the condition holds; all values see the old row."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def update_keys(df: DataFrame, keys: DataFrame, on: str, **values: Column) -> DataFrame:
    """As update, for the rows whose key is in another table. The keys are joined, not gathered."""
    marked = df.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left").select(*df.columns, "_hit")
    return update(marked, F.col("_hit"), **values).select(*df.columns)


def compare_and_set(df: DataFrame, where: Column, column: str, expected: str, new: str, **more: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows, one row `changed`): the column set where it has the expected value, and how many rows that were."""
    hit = where & (F.col(column) == expected)
    return update(df, hit, **{column: F.lit(new)}, **more), df.agg(F.count_if(hit).alias("changed"))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti").select(*df.columns)


def last_of(new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`; without it, or at a tie, the greatest by all its columns, so always the same."""
    rows = F.struct(*([F.col(order).alias("_o")] if order else []), *[F.col(c) for c in new.columns])
    return new.groupBy(*keys).agg(F.max(rows).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in new.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows take the place of old rows of the same key; children of the row stay. Of several new rows of one key the last
    counts (see last_of)."""
    one = last_of(new, keys, order)
    return delete_keys(old, one, keys).unionByName(one.select(*old.columns))


def insert(old: DataFrame, new: DataFrame, keys: list[str], unique: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """New rows added; a key that is there already, or twice among the new rows, raises when the result is read.

    Only the keys of the old rows that new rows ask for are joined; no old row is sorted or counted.
    """
    checked = new.select(*old.columns)
    for k in [tuple(keys), *unique]:
        wanted = new.select(*k).distinct()
        taken = old.select(*k).join(wanted, list(k), "left_semi").select(*k).distinct().withColumn("_taken", F.lit(True))
        many = F.count("*").over(W.partitionBy(*k)) > 1
        error = F.raise_error(F.lit(f"key is taken: {', '.join(k)}")).cast("boolean")
        checked = checked.join(taken, list(k), "left").withColumn("_many", many)
        checked = checked.where(F.when(F.col("_taken") | F.col("_many"), error).otherwise(F.lit(True))).select(*old.columns)
    return old.unionByName(checked)


def replace(old: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows given by key out, new rows in; a new key that is still taken raises."""
    return insert(delete_keys(old, gone, keys), new, keys)


def with_children(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, keys: list[str], child_keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) after parents are upserted and then their children put in place of those of the same key; a child whose
    parent is in neither set raises."""
    p = upsert(parents, new_parents, keys)
    known = p.select(F.col(keys[0]).alias(column)).join(new_children.select(column).distinct(), column, "left_semi").withColumn("_ok", F.lit(True))
    orphan = F.when(F.col("_ok").isNull(), F.raise_error(F.lit("parent is missing")).cast("boolean")).otherwise(F.lit(True))
    good = new_children.join(known, column, "left").where(orphan).select(*new_children.columns)
    return p, upsert(children, good, child_keys)


def cascade_delete(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables after rows of one of them, given by key, are gone with everything that refers to them."""
    out = dict(tables)
    key = list(schema.KEYS[table])
    gone = {table: tables[table].join(keys.select(*key).distinct(), key, "left_semi")}
    out[table] = delete_keys(tables[table], keys, key)
    for child, (column, parent, parent_key) in schema.CASCADES.items():
        if parent in gone and child in tables:
            dead = gone[parent].select(F.col(parent_key).alias(column)).distinct()
            gone[child] = tables[child].join(dead, column, "left_semi")
            out[child] = tables[child].join(dead, column, "left_anti").select(*tables[child].columns)
    if table == "documents" and "document_tags" in tables:  # no reference is declared: cleared by the operation itself
        out["document_tags"] = tables["document_tags"].join(keys.select(F.col("id").alias("documentId")), "documentId", "left_anti")
    return out


def undo_last(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows without the newest of each group."""
    last = newest(df, by, order).select(*by, *[c for c in ("id",) if c in df.columns])
    return df.join(last, [*by, "id"], "left_anti").select(*df.columns)


def refresh_corrected(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """documents with fullTranslationCorrectedCount counted again."""
    n = sentences.groupBy(F.col("documentId").alias("id")).agg(F.count_if(F.col("correctedText").isNotNull()).cast("int").alias("_n"))
    out = documents.join(n, "id", "left")
    return out.select(*[F.coalesce("_n", F.lit(0)).alias(c) if c == "fullTranslationCorrectedCount" else F.col(c) for c in documents.columns])


def clear_folder(documents: DataFrame, folders: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents taken out of the folders, and the folders left."""
    docs = update_keys(documents, dead.select(F.col("id").alias("folderId")), "folderId", folderId=F.lit(None).cast("string"))
    return docs, delete_keys(folders, dead, ["id"])


def resolve_reviews(reviews: DataFrame, accept: DataFrame, sentences: DataFrame, translations: DataFrame, now: Column, documents: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """(reviews left, sentences, translations) after reviews, given as (sentenceId, accept), are resolved; with documents also
    these, their corrected sentences counted again where a review went.

    An accepted proposal becomes the correction unless it is the original text; its translation is stored with the usage known
    before, or none. Every resolved review goes.
    """
    taken = reviews.join(accept.where("accept").select("sentenceId"), "sentenceId", "left_semi")
    prop = taken.select(F.col("sentenceId").alias("id"), F.col("proposedText").alias("_p"), F.lit(True).alias("_hit"))
    s = sentences.join(prop, "id", "left")
    s = s.select(*[F.when(F.col("_hit"), F.nullif("_p", "originalText")).otherwise(F.col(c)).alias(c) if c == "correctedText" else F.col(c) for c in sentences.columns])
    zero = {"costCurrency": F.lit(""), "costAmount": F.lit("0")}
    new = taken.select("sentenceId", F.col("proposedText").alias("sourceText"), "translatedText")
    old = translations.drop("sourceText", "translatedText", "updatedAt")
    kept = [c for c in old.columns if c != "sentenceId"]
    new = new.join(old, "sentenceId", "left").select(
        "sentenceId", "sourceText", "translatedText", *[F.coalesce(c, zero.get(c, F.lit(0))).alias(c) for c in kept], now.alias("updatedAt"))
    out = delete_keys(reviews, accept, ["sentenceId"]), s, upsert(translations, new, ["sentenceId"])
    if documents is None:
        return out
    touched = reviews.join(accept.select("sentenceId").distinct(), "sentenceId", "left_semi").select("documentId").distinct()
    n = s.join(touched, "documentId", "left_semi").groupBy("documentId").agg(F.count_if(F.col("correctedText").isNotNull()).cast("int").alias("_n"))
    counted = touched.join(n, "documentId", "left").select(F.col("documentId").alias("id"), F.coalesce("_n", F.lit(0)).alias("_n"))
    d = documents.join(counted, "id", "left")
    return *out, d.select(*[F.coalesce("_n", c).alias(c) if c == "fullTranslationCorrectedCount" else F.col(c) for c in documents.columns])


def apply_batch(reviews: DataFrame, sentences: DataFrame, translations: DataFrame, batch: DataFrame, corrections: DataFrame, new_translations: DataFrame, new_reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, sentences, translations) after one batch: its old reviews go, corrections are set, answers and new reviews stored."""
    c = corrections.select(F.col("sentenceId").alias("id"), F.col("correctedText").alias("_c"), F.lit(True).alias("_hit"))
    s = sentences.join(c, "id", "left")
    s = s.select(*[F.when(F.col("_hit"), F.col("_c")).otherwise(F.col(x)).alias(x) if x == "correctedText" else F.col(x) for x in sentences.columns])
    r = upsert(delete_keys(reviews, batch, ["sentenceId"]), new_reviews, ["sentenceId"])
    return r, s, upsert(translations, new_translations, ["sentenceId"])


def replace_page(tables: dict[str, DataFrame], page: DataFrame, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after pages, given as (documentId, pageNumber, ...), are published again: blocks and evidence replaced, the
    page, sentences and spans upserted. Sentences of the page that do not come again stay."""
    at = ["documentId", "pageNumber"]
    out = dict(tables)
    for t in ("page_layout_blocks", "page_evidence"):
        if t in tables:
            out[t] = delete_keys(tables[t], page, at).unionByName(rows[t])
    for t in ("pages", "sentences", "sentence_spans"):
        if t in tables and (t in rows or t == "pages"):
            out[t] = upsert(tables[t], page if t == "pages" else rows[t], list(schema.KEYS[t]))
    return out


def reset_index(tables: dict[str, DataFrame], ids: DataFrame, context: str = "PENDING") -> dict[str, DataFrame]:
    """Tables after everything derived from documents, given by id, is wiped: their progress, the analysis of their context (its status
    is given) and their translation with all counters are as at first."""
    out = dict(tables)
    by = ids.select(F.col("id").alias("documentId"))
    if "sentences" in tables:
        dead = tables["sentences"].join(by, "documentId", "left_semi")
        out |= cascade_delete({k: v for k, v in tables.items() if k != "documents"}, "sentences", dead.select("id"))
    for t in ("page_layout_blocks", "page_evidence", "pages"):
        if t in tables:
            out[t] = tables[t].join(by, "documentId", "left_anti").select(*tables[t].columns)
    first = {**schema.DEFAULTS["documents"], "aiContextStatus": context, **dict.fromkeys(("errorMessage", "aiContextSummary", "aiContextError", "fullTranslationError"))}
    del first["isTrashed"]
    kinds = {f.name: f.dataType for f in schema.TABLES["documents"]}
    out["documents"] = update_keys(tables["documents"], ids, "id", **{c: F.lit(v).cast(kinds[c]) for c, v in first.items()})
    return out


def organised(documents: DataFrame, tags: DataFrame, bridge: DataFrame, choice: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, tags, document_tags) after documents get a folder and tags: `choice` has (id, folderId, names).

    Names are trimmed, blank ones dropped, and those that differ in letter case count once in their first spelling; the tags a
    document had before go.
    """
    c = choice.select(F.col("id"), F.col("folderId").alias("_f"), F.lit(True).alias("_hit"))
    docs = documents.join(c, "id", "left").select(*[F.when(F.col("_hit"), F.col("_f")).otherwise(F.col(x)).alias(x) if x == "folderId" else F.col(x) for x in documents.columns])
    each = choice.select(F.col("id").alias("documentId"), F.posexplode("names").alias("ord", "name"))
    named = distinct_names(each, ["documentId"])
    new_tags = named.groupBy("id").agg(F.min("name").alias("name"))
    rows = delete_keys(bridge, choice.select(F.col("id").alias("documentId")), ["documentId"]).unionByName(named.select("documentId", F.col("id").alias("tagId")))
    return docs, upsert(tags, new_tags, ["id"]), rows


def required(keys: DataFrame) -> DataFrame:
    """The keys of a bulk operation; none at all raise when the result is read."""
    some = keys.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("nothing is selected")).cast("boolean")).otherwise(F.lit(True)).alias("_some"))
    return some.join(keys.withColumn("_some", F.lit(True)), "_some", "left").where("_some").select(*keys.columns)


def migrate(df: DataFrame, target: str) -> DataFrame:
    """Rows of an older schema in the present one: a missing column gets its default, else null where allowed, else the type's."""
    plain = {"string": "", "int": 0, "bigint": 0, "float": 0.0, "boolean": False}
    default = schema.DEFAULTS.get(target, {})
    out = []
    for f in schema.TABLES[target]:
        kind = f.dataType.simpleString()
        missing = default.get(f.name, None if f.nullable else plain.get(kind))
        out.append((F.col(f.name) if f.name in df.columns else F.lit(missing)).cast(f.dataType).alias(f.name))
    return df.select(*out)


def settings_map(settings: DataFrame, owner: list[str] | None = None, order: str = "ord") -> DataFrame:
    """Rows of (key, value) as one map, per owner if there are any; of a repeated key the last by `order` counts."""
    last = settings.groupBy(*(owner or []), "key").agg(F.max(F.struct(order, "value"))["value"].alias("value"))
    return last.groupBy(*(owner or [])).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def setting_rows(values: dict[str, Column]) -> Column:
    """Typed settings as rows of (key, value) to be exploded and upserted; values become text."""
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])


def translation_settings(model: Column, prompt: Column, ratio: Column) -> Column:
    """Setting rows of a model and a prompt, trimmed; a blank model, or a prompt without {text}, raises. The ratio is kept within
    0.05 and 1."""
    m, p = strip(model), strip(prompt)
    bad = F.when(m == "", F.raise_error(F.lit("the model has no name"))).when(~p.contains("{text}"), F.raise_error(F.lit("the prompt lacks {text}")))
    return setting_rows({"model": F.coalesce(bad.cast("string"), m), "prompt": p, "max_change_ratio": F.greatest(F.lit(0.05), F.least(F.lit(1.0), ratio))})


def document_setting(settings: DataFrame, ids: DataFrame, prefix: str) -> DataFrame:
    """(id, value): the setting that each document has of its own, keyed by prefix and id; null where it has none."""
    own = settings.where(F.col("key").startswith(prefix)).select(F.substring("key", F.lit(len(prefix) + 1), F.length("key")).alias("id"), "value")
    return ids.select("id").join(own, "id", "left")
