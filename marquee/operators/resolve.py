"""Batches against the catalog: validation, identity, upsert with locked fields, lookups, casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM
from marquee.operators.catalog import last_wins


def reject_reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))


def validate_rows(rows: DataFrame, required: list[str], lengths: dict[str, int], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with ``reject_reasons``; those without a reason are good."""
    rules = {f"{c} missing": F.col(c).isNull() for c in required}
    rules |= {f"{c} too long": F.coalesce(F.length(c) > n, F.lit(False)) for c, n in lengths.items()}
    rules |= {f"{c} out of range": F.coalesce(~F.col(c).between(*r) | F.isnan(F.col(c).cast("double")), F.lit(False)) for c, r in ranges.items()}
    return rows.withColumn("reject_reasons", reject_reasons(rules))


def coerced(value: Column, kind: str) -> tuple[Column, Column]:
    """(value in the kind, why it can't be), the reason null where it can. Kinds: smallint, int, bigint, decimal(p,s), date,
    timestamp and varchar(n). Whole numbers may be written with a zero fraction; decimals are rounded half up to
    their scale and must be finite."""
    text = F.trim(value.cast("string"))
    if kind.startswith("varchar"):
        limit = int(kind[8:-1])
        whole = value.cast("string")
        return whole, F.when(F.length(whole) > limit, F.concat(F.lit("longer than "), F.lit(str(limit))))
    if kind in ("date", "timestamp"):
        made = value.cast("string").try_cast(kind)
        return made, F.when(value.isNotNull() & made.isNull(), F.lit(f"not a {kind}"))
    if kind.startswith("decimal"):
        precision, scale = map(int, kind[8:-1].split(","))
        number = text.try_cast("double")
        exact = F.round(text.try_cast("decimal(38,18)"), scale)
        too_large = F.abs(exact) >= F.lit(10 ** (precision - scale))
        odd = F.when(number.isNull(), "not a number").when(F.isnan(number) | (F.abs(number) == float("inf")), "not finite").when(exact.isNull() | too_large, "out of range")
        return F.when(odd.isNull(), exact).cast(kind), F.when(value.isNotNull(), odd)
    whole = F.regexp_replace(text, r"\.0*$", "")
    made = whole.try_cast(kind)
    odd = F.when(~whole.rlike("^[+-]?[0-9]+$"), "not a whole number").when(made.isNull(), "out of range")
    return made, F.when(value.isNotNull(), odd)


def coerce_rows(rows: DataFrame, kinds: dict[str, str], required: list[str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with the columns in the kinds of the table that they go to, and ``reject_reasons`` of those that can't be. A
    required column must have a value, a column with a default gets it for null."""
    out, reasons = [], []
    for c, kind in kinds.items():
        value = F.coalesce(F.col(c), F.lit((defaults or {})[c]).cast(rows.schema[c].dataType)) if c in (defaults or {}) else F.col(c)
        made, odd = coerced(value, kind)
        out.append(made.alias(c))
        reasons.append(F.when(odd.isNotNull(), F.concat(F.lit(f"{c} "), odd)))
        if c in (required or []):
            reasons.append(F.when(value.isNull(), F.lit(f"{c} missing")))
    kept = [F.col(c) for c in rows.columns if c not in kinds]
    return rows.select(*kept, *out, F.array_compact(F.array(*reasons)).alias("reject_reasons"))


def upsert(target: DataFrame, batch: DataFrame, key: list[str], columns: list[str], locked: dict[str, str] | None = None) -> DataFrame:
    """The target with the batch's columns in, by a full outer join; ``outcome`` is created, updated or kept.

    Of a key's rows in the batch the last by ``pos`` counts. locked: column -> the target's flag that keeps its value."""
    fresh = last_wins(batch.select(*key, "pos", *columns), key, "pos").drop("pos")
    fresh = fresh.withColumnsRenamed({c: f"new_{c}" for c in columns}).withColumn("is_new", F.lit(True))
    joined = target.withColumn("was_there", F.lit(True)).join(fresh, key, "full_outer")
    there, new = F.col("was_there").isNotNull(), F.col("is_new").isNotNull()

    def value(c: str) -> Column:
        keeps = ~new
        if locked and c in locked:
            keeps = keeps | (there & F.coalesce(F.col(locked[c]), F.lit(False)))
        return F.when(keeps, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)

    outcome = F.when(there & new, "updated").when(there, "kept").otherwise("created").alias("outcome")
    rest = [c for c in target.columns if c not in columns and c not in key]
    return joined.select(*key, *(value(c) for c in columns), *rest, outcome)


def load_report(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    return outcomes.groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("n"))


def batch_report(rows: DataFrame, outcomes: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """(part, outcome, n) of a whole load: what became of the batch's rows (validated: rejected or not), of the table
    (created, updated), of people (found_by) and of claimed external ids (outcome)."""
    judged = rows.select(F.when(F.size("reject_reasons") > 0, "rejected").otherwise("accepted").alias("outcome"))
    parts = {"rows": judged, "items": outcomes.filter("outcome <> 'kept'").select("outcome"), "people": people.select(F.col("found_by").alias("outcome")), "links": links.select("outcome")}
    return reduce(DataFrame.unionByName, (load_report(df).select(F.lit(name).alias("part"), "outcome", "n") for name, df in parts.items()))


def link_external_ids(batch: DataFrame, links: DataFrame) -> DataFrame:
    """(item, source, external_id, outcome) for a batch (pos, item, source, external_id) against the known links.

    The first claim of an id in the batch stands, the others are ``contested``; of two ids for one item the last wins and
    the first is ``superseded``; an id that another item holds is ``taken``; a link that replaces the item's own id is
    ``replaced``, one that is there is ``known``, the rest are ``linked``."""
    claims = batch.withColumn("nth", F.row_number().over(Window.partitionBy("item_type", "source", "external_id").orderBy("pos")))
    holder = links.select("item_type", "source", "external_id", F.col("item_id").alias("holder"))
    own = links.select(*ITEM, "source", F.col("external_id").alias("own_id"))
    known = claims.join(holder, ["item_type", "source", "external_id"], "left").join(own, [*ITEM, "source"], "left")
    first = F.when(F.col("nth") > 1, "contested").when(F.col("holder").isNotNull() & (F.col("holder") != F.col("item_id")), "taken")
    known = known.withColumn("refused", first)
    later = Window.partitionBy(*ITEM, "source", F.col("refused").isNull()).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    superseded = F.max("pos").over(later).isNotNull() & F.col("refused").isNull()
    outcome = F.coalesce("refused", F.when(superseded, "superseded").when(F.col("own_id") == F.col("external_id"), "known").when(F.col("own_id").isNotNull(), "replaced").otherwise("linked"))
    return known.select("pos", *ITEM, "source", "external_id", outcome.alias("outcome"))


def sync_genres(links: DataFrame, batch: DataFrame, locked: DataFrame) -> DataFrame:
    """Genre links (item, genre) after a batch (item, genres): those of items with a list that isn't empty and not locked
    are replaced, all others stay."""
    touched = batch.filter(F.size("genres") > 0).join(locked.select(*ITEM), ITEM, "left_anti")
    fresh = touched.select(*ITEM, F.explode("genres").alias("genre")).distinct()
    return links.join(touched.select(*ITEM), ITEM, "left_anti").select(*ITEM, "genre").unionByName(fresh)


def sync_lookup(vocabulary: DataFrame, links: DataFrame, batch: DataFrame, locked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, links) after a batch (pos, item, entries: array of name, slug) of genres or platforms.

    Unknown slugs join the vocabulary (slug, name) under the first name by ``pos``, known names stay. The links (item, slug) of an
    item are replaced unless its list is empty or it is among the locked."""
    touched = batch.filter(F.size("entries") > 0)
    if locked is not None:
        touched = touched.join(locked.select(*ITEM), ITEM, "left_anti")
    named = touched.select("pos", *ITEM, F.posexplode("entries").alias("at", "e")).select("pos", "at", *ITEM, "e.name", "e.slug")
    fresh = named.groupBy("slug").agg(F.min_by("name", F.struct("pos", "at")).alias("name")).join(vocabulary.select("slug"), "slug", "left_anti")
    kept = links.join(touched.select(*ITEM), ITEM, "left_anti").select(*ITEM, "slug")
    return vocabulary.select("slug", "name").unionByName(fresh), kept.unionByName(named.select(*ITEM, "slug").distinct())


def purge_genres(links: DataFrame, locked: DataFrame) -> DataFrame:
    """Genre links of items whose genres are locked; the others' are dropped."""
    return links.join(locked.select(*ITEM), ITEM, "left_semi")


def used_genres(vocabulary: DataFrame, links: DataFrame) -> DataFrame:
    """The genres that an item still has; those that none has are dropped."""
    return vocabulary.join(links.select("genre"), "genre", "left_semi")


def build_cast(cast: DataFrame) -> DataFrame:
    """(item, cast): the named members by billing, no billing last, then in the order of input."""
    order = F.struct(F.col("billing").isNull().alias("last"), "billing", "pos", "name", F.col("character_name").alias("character"))
    members = F.array_sort(F.collect_list(order))
    return cast.filter("name is not null and trim(name) <> ''").groupBy(*ITEM).agg(F.transform(members, lambda m: F.struct(m["name"].alias("n"), m["character"].alias("c"), m["billing"].alias("o"))).alias("cast"))


def cast_only_people(credits: DataFrame) -> DataFrame:
    return credits.groupBy("person_id").agg(F.bool_and(F.col("role") == "ACTOR").alias("only")).filter("only").select("person_id")


def edit_problems(edits: DataFrame, editable: list[str], columns: list[str]) -> DataFrame:
    """Edits (item, columns, lock, unlock) with ``problems``: fields that nobody may edit, and a title of white space."""
    fields = F.array_union(F.coalesce("lock", F.array().cast("array<string>")), F.coalesce("unlock", F.array().cast("array<string>")))
    foreign = F.transform(F.array_sort(F.array_except(fields, F.array(*map(F.lit, editable)))), lambda f: F.concat(F.lit("not editable: "), f))
    set_foreign = [F.when(F.col(c).isNotNull(), F.lit(f"not editable: {c}")) for c in columns if c not in editable]
    blank = [F.when(F.trim("title") == "", F.lit("blank title"))] if "title" in columns else []
    return edits.withColumn("problems", F.array_distinct(F.concat(foreign, F.array_compact(F.array(*set_foreign, *blank)).cast("array<string>"))))


def apply_edits(items: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Items with an editor's values (item, columns, lock, unlock: arrays of names); an edited field is locked, then
    the unlocked ones are opened. Null leaves a field as it is. Take edits without problems."""
    named = edits.withColumnsRenamed({c: f"new_{c}" for c in columns})
    joined = items.join(named, ITEM, "left")
    locks = F.array_except(F.array_union(F.coalesce("locked_fields", F.array().cast("array<string>")), F.coalesce("lock", F.array().cast("array<string>"))), F.coalesce("unlock", F.array().cast("array<string>")))
    values = [F.coalesce(f"new_{c}", c).alias(c) for c in columns]
    return joined.select(*(c for c in items.columns if c not in columns and c != "locked_fields"), *values, locks.alias("locked_fields"))


def align_slugs(batch: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """What becomes of the slugs of a batch (pos, item_type, source, external_id, slug) whose rows the external id finds.

    ``new`` has no row yet, ``same`` changes nothing; a locked title keeps its slug (``locked``), a slug of another row isn't
    taken (``owned``), one that several rows of the batch want goes to none (``contested``); the rest are ``renamed``.

    Batch and catalog are of one order, and a packed file of either says little of its size in memory: so none is broadcast whole."""
    found = batch.join(links.hint("merge"), ["item_type", "source", "external_id"], "left")
    current = items.select(*ITEM, F.col("slug").alias("current"), "title_locked")
    owners = items.select("item_type", "slug", F.col("item_id").alias("owner")).groupBy("item_type", "slug").agg(F.min("owner").alias("owner"), F.count("*").alias("owners"))
    wanted = batch.groupBy("item_type", "slug").agg(F.count_distinct("external_id").alias("claims"))
    rows = found.join(current.hint("merge"), ITEM, "left").join(owners.hint("merge"), ["item_type", "slug"], "left").join(wanted.hint("merge"), ["item_type", "slug"], "left")
    taken = F.col("owner").isNotNull() & ((F.col("owner") != F.col("item_id")) | (F.col("owners") > 1))
    outcome = (
        F.when(F.col("current").isNull(), "new")
        .when(F.col("current") == F.col("slug"), "same")
        .when(F.col("title_locked"), "locked")
        .when(taken, "owned")
        .when(F.col("claims") > 1, "contested")
        .otherwise("renamed")
    )
    return rows.select("pos", *ITEM, "slug", outcome.alias("outcome"), F.when(F.col("current").isNull() | (outcome == "renamed"), F.col("slug")).otherwise(F.col("current")).alias("final_slug"))


def resolve_people(batch: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """(source, external_id, slug, found_by, person_id) once for each external id of a batch (pos, source, external_id, slug,
    name): by its link, else by slug, else new under the slug; of several new ids with one slug the first makes the person."""
    first = batch.groupBy("source", "external_id").agg(F.min_by(F.struct("slug", "name"), "pos").alias("p"), F.min("pos").alias("pos")).select("source", "external_id", "pos", "p.*")
    known = first.join(links.select("source", "external_id", F.col("person_id").alias("linked_id")), ["source", "external_id"], "left")
    known = known.join(people.select("slug", F.col("person_id").alias("slug_id")), "slug", "left")
    fresh = F.col("linked_id").isNull() & F.col("slug_id").isNull()
    nth = F.row_number().over(Window.partitionBy("slug", fresh).orderBy("pos"))
    found_by = F.when(F.col("linked_id").isNotNull(), "link").when(F.col("slug_id").isNotNull(), "slug").when(nth == 1, "new").otherwise("same_as_new")
    return known.select("source", "external_id", "slug", found_by.alias("found_by"), F.coalesce("linked_id", "slug_id").alias("person_id"))


def load_people(batch: DataFrame, people: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, links) after a batch (pos, source, external_id, slug, name). A new person's id is a hash of the slug, so that
    a repeated load finds the same one; every id of the batch is linked, known links stay."""
    found = resolve_people(batch, people.select("person_id", "slug"), links)
    named = batch.groupBy("slug").agg(F.min_by("name", "pos").alias("name"))
    new_id = F.xxhash64(F.lit("person"), "slug").bitwiseAND(F.lit((1 << 62) - 1))
    fresh = found.filter("found_by = 'new'").join(named, "slug").select(new_id.alias("person_id"), "name", "slug")
    resolved = found.select("source", "external_id", F.coalesce("person_id", new_id).alias("person_id"))
    added = resolved.join(links, ["source", "external_id"], "left_anti")
    return people.select("person_id", "name", "slug").unionByName(fresh), links.select("source", "external_id", "person_id").unionByName(added)


def load_item_people(batch: DataFrame, cast: DataFrame, credits: DataFrame, people: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cast, credits, people, links, rejected) after a batch (pos, item, source, external_id, slug, name, role, character_name,
    billing) of items' people: who has no id or name is rejected, people are found or made, and credits follow."""
    whole = F.col("external_id").isNotNull() & F.coalesce(F.trim("name") != "", F.lit(False))
    good, rejected = batch.filter(whole), batch.filter(~whole)
    crew = good.filter("role <> 'ACTOR'")
    known, linked = load_people(crew, people, links)
    named = crew.join(linked, ["source", "external_id"]).select("pos", *ITEM, "person_id", "name", "role", "character_name", "billing")
    actors = good.filter("role = 'ACTOR'").select("pos", *ITEM, F.lit(0).cast("long").alias("person_id"), "name", "role", "character_name", "billing")
    fresh, all_credits, _ = load_credits(cast, credits, named.unionByName(actors))
    return fresh, all_credits, known, linked, rejected


def mark_synced(items: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    hit = ids.select(*ITEM).distinct().withColumn("hit", F.lit(True))
    return items.join(hit, ITEM, "left").withColumn(column, F.when(F.col("hit"), F.lit(value)).otherwise(F.col(column))).drop("hit")


def company_rows(companies: DataFrame, credits: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, credits) after a batch (item, companies: array of name, slug, role): unknown slugs are added under the
    first name by ``pos``, a credit that is there stays one."""
    named = batch.select("pos", *ITEM, F.explode("companies").alias("c")).select("pos", *ITEM, "c.*")
    fresh = named.groupBy("slug").agg(F.min_by("name", "pos").alias("name")).join(companies.select("slug"), "slug", "left_anti")
    linked = named.select(*ITEM, "slug", "role").union(credits.select(*ITEM, "slug", "role")).distinct()
    return companies.select("slug", "name").unionByName(fresh), linked


def load_credits(cast: DataFrame, credits: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cast, credits, rejected) after a batch (pos, item, person_id, name, role, character_name, billing).

    Actors become the item's cast, which is replaced where the batch has any; other roles are added to the credits once;
    who has no name or id is rejected. Credits are brought together by item, so that whoever asks by item needn't shuffle them again."""
    whole = F.col("person_id").isNotNull() & F.coalesce(F.trim("name") != "", F.lit(False))
    good, rejected = batch.filter(whole), batch.filter(~whole)
    fresh = build_cast(good.filter("role = 'ACTOR'"))
    kept = cast.join(fresh.select(*ITEM), ITEM, "left_anti")
    crew = good.filter("role <> 'ACTOR'").select(*ITEM, "person_id", "role")
    return kept.unionByName(fresh), credits.select(*ITEM, "person_id", "role").union(crew).repartition(*ITEM).distinct(), rejected
