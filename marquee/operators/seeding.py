"""The end of a dump's way: selected books with their people and credits into the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import ITEM, slugify
from marquee.functions.fold import ascii_fold
from marquee.operators.resolve import load_people
from marquee.sources.landed import slug_of
from marquee.sources.shared import kept
from marquee.sources.versioned import VersionedTable

SOURCE, PEOPLE_SOURCE = "OPENLIBRARY", "OPEN_LIBRARY"
BOOK_COLUMNS = ["title", "slug", "overview", "release_date"]


@dataclass
class Seeded:
    """The catalog's version, (item_id, work_id, outcome) of the books, and the tables as they are afterwards."""

    version: int
    books: DataFrame
    links: DataFrame
    people: DataFrame
    people_links: DataFrame
    credits: DataFrame


def book_batch(books: DataFrame, links: DataFrame) -> DataFrame:
    """Books of a dump (work_id, title, overview, release_date) as a batch for the catalog (pos, item, work_id, columns): the item that
    the work is linked to, or a new one whose id is a hash of the work, so that a repeated load finds the same one."""
    own = links.filter((F.col("item_type") == "BOOK") & (F.col("source") == SOURCE)).select(F.col("external_id").alias("work_id"), F.col("item_id").alias("known"))
    fresh = F.xxhash64(F.lit("book"), "work_id").bitwiseAND(F.lit((1 << 62) - 1))
    rows = books.join(own, "work_id", "left")
    slug = slug_of(F.col("title"), F.col("release_date"), SOURCE, F.col("work_id"))
    return rows.select(F.coalesce("known", fresh).alias("pos"), F.when(F.lit(True), "BOOK").alias("item_type"), F.coalesce("known", fresh).alias("item_id"), "work_id", "title", slug.alias("slug"), "overview", "release_date")


def author_batch(credits: DataFrame, batch: DataFrame) -> DataFrame:
    """Authors (work_id, author_id, name, billing) as a batch of people (pos, item, source, external_id, slug, name, role). A name that has
    nothing in ASCII gets a slug of the source and its id there, so that such authors don't become one."""
    base = slugify(ascii_fold(F.coalesce("name", F.lit(""))))
    slug = F.when(base == "", F.concat_ws("-", F.lit(PEOPLE_SOURCE.lower()), F.lower("author_id"))).otherwise(base)
    rows = credits.join(batch.select("work_id", *ITEM), "work_id")
    return rows.select(F.struct("work_id", "billing").alias("pos"), *ITEM, F.lit(PEOPLE_SOURCE).alias("source"), F.col("author_id").alias("external_id"), slug.alias("slug"), "name", F.lit("AUTHOR").alias("role"))


def seed_catalog(table: VersionedTable, books: DataFrame, authors: DataFrame, links: DataFrame, people: DataFrame, people_links: DataFrame, credits: DataFrame, locked: dict[str, str] | None = None) -> Seeded:
    """Put books and authors of a dump (see ``dumps.seed_books``) into the catalog: the table takes the batch as a new version, what is
    locked stays; people are found by link or slug or made; every author is credited once. Both batches are written once in the shared folder.

    links (item, source, external_id), people (person_id, name, slug), people_links (source, external_id, person_id), credits (item,
    person_id, role)."""
    batch = kept(book_batch(books, links), "book-batch")
    version, outcomes = table.upsert(batch, BOOK_COLUMNS, locked)
    new_links = batch.select(*ITEM, F.lit(SOURCE).alias("source"), F.col("work_id").alias("external_id")).join(links, ["item_type", "source", "external_id"], "left_anti")
    written = kept(author_batch(authors, batch), "author-batch")
    everyone, linked = load_people(written, people, people_links)
    named = written.join(linked, ["source", "external_id"]).select(*ITEM, "person_id", "role")
    return Seeded(
        version,
        outcomes.join(batch.select(*ITEM, "work_id"), ITEM).select("item_id", "work_id", "outcome"),
        links.select(*ITEM, "source", "external_id").unionByName(new_links.select(*ITEM, "source", "external_id")),
        everyone,
        linked,
        credits.select(*ITEM, "person_id", "role").union(named).distinct(),
    )
