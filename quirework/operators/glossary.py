"""Glossary: surfaces, conflicts, overlays, and where terms occur."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.session import ship

#: A glossary is a stated table; its surfaces are searched in blocks of so many.
SURFACES_PER_PASS = 200_000


def surfaces(glossary: DataFrame) -> DataFrame:
    """``id, surface`` of source terms and aliases, in small letters, each once an entry."""
    every = F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = glossary.select("id", F.explode(every).alias("surface"))
    return rows.select("id", F.trim(F.lower("surface")).alias("surface")).where(F.length("surface") > 0).distinct()


def conflicts(glossary: DataFrame) -> DataFrame:
    """Surfaces that several entries claim."""
    owners = surfaces(glossary).groupBy("surface").agg(F.countDistinct("id").alias("n_entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return owners.where("n_entries > 1")


def overlay(base: DataFrame, later: DataFrame) -> DataFrame:
    """``base`` without the entries that ``later`` redefines, by id or by any shared surface, and ``later``."""
    redefined = surfaces(base).join(surfaces(later).select("surface").distinct(), "surface", "left_semi").select("id")
    redefined = redefined.unionByName(later.select("id")).distinct()
    return base.join(redefined, "id", "left_anti").unionByName(later)


# Regular endings of an English word; one that ends in a consonant and y changes its end.
ENDINGS = ("", "s", "es", "'s", "’s")
Y_ENDINGS = ("y", "ies", "y's", "y’s")
_CONSONANT_Y = re.compile("[^aeiou]y$", re.I)
_WORD = re.compile(r"\w")


def forms(surface: str) -> tuple[list[str], bool]:
    """What a surface may look like in a text, and whether it must stand as words of its own."""
    if not surface.isascii() or not re.search("[A-Za-z0-9]", surface):
        return [surface], False
    if _CONSONANT_Y.search(surface):
        return [surface[:-1] + e for e in Y_ENDINGS], True
    return [surface + e for e in (ENDINGS if surface[-1].isalpha() else ("",))], True


class Finder:
    """An Aho-Corasick automaton over all forms of all surfaces; its cost a text does not depend on how many there are."""

    def __init__(self, stated: tuple[tuple[str, str], ...]) -> None:
        import ahocorasick

        owners: dict[str, list[tuple[int, bool]]] = {}
        for k, (_, surface) in enumerate(stated):
            found, whole = forms(surface)
            for form in found:
                owners.setdefault(form, []).append((k, whole))
        self.automaton = ahocorasick.Automaton()
        for form, claims in owners.items():
            self.automaton.add_word(form, (len(form), claims))
        if owners:
            self.automaton.make_automaton()
        self.ids = [e for e, _ in stated]

    def counts(self, text: str) -> dict[str, int]:
        """Entry -> how often its surfaces occur; occurrences of one surface don't overlap, the earliest and longest count."""
        if not len(self.automaton):
            return {}
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, claims) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            alone = not (start and _WORD.match(text, start - 1)) and not _WORD.match(text, end)
            for k, whole in claims:
                if alone or not whole:
                    found.setdefault(k, []).append((start, -end))
        out: dict[str, int] = {}
        for k, spans in found.items():
            at = n = 0
            for start, end in sorted(spans):
                if start >= at:
                    at, n = -end, n + 1
            out[self.ids[k]] = out.get(self.ids[k], 0) + n
        return out


@lru_cache(2)
def _finder(stated: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(stated)


def matches(texts: DataFrame, glossary: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key, id, n``: how often the surfaces of each entry occur in each text.

    The terms are stated; they are read to the driver in blocks, and every text
    is gone through once for a block, in the scan's stage, without a join. Only
    the keys of rows with a hit go on, with a hash of the text, so that a row
    delivered twice counts once and no text is ever shuffled.
    """
    stated = surfaces(glossary).orderBy("id", "surface").toLocalIterator()
    texts = texts.select(*key, F.lower(text).alias("_lower")).where(F.length("_lower") > 0).select(*key, F.xxhash64("_lower").alias("_text"), "_lower")
    carried = [*key, "_text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*carried).schema), "id string", "n bigint"])
    hits = None
    while hits is None or block:
        block = tuple((r.id, r.surface) for r in islice(stated, SURFACES_PER_PASS))
        if hits is not None and not block:
            break

        def search(batches, block=block):
            finder = _finder(block)
            for batch in batches:
                at, ids, counts = [], [], []
                for i, value in enumerate(batch.column(len(carried)).to_pylist()):
                    for e, n in finder.counts(value).items() if value else ():
                        at.append(i)
                        ids.append(e)
                        counts.append(n)
                keys = batch.take(pa.array(at, pa.int32())).columns[: len(carried)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.string()), pa.array(counts, pa.int64())], names=[*carried, "id", "n"])

        ship(texts.sparkSession)
        found = texts.mapInArrow(search, schema)
        hits = found if hits is None else hits.unionByName(found)
    once = hits.repartition(*key, "id").groupBy(*carried, "id").agg(F.max("n").alias("n"))
    return once.groupBy(*key, "id").agg(F.sum("n").alias("n"))


def target_present(text: Column, target: Column) -> Column:
    """Whether a target stands in a text in its own case: as a word with a regular ending if it is Latin, else anywhere."""
    quoted = F.regexp_replace(target, "([^\\p{L}\\p{N}\\s_])", "\\\\$1")
    body = (
        F.when(target.rlike("(?i)[^aeiou]y$"), F.concat(F.regexp_replace(quoted, ".$", ""), F.lit("(?:y|ies|y['’]s)")))
        .when(target.rlike("[A-Za-z]$"), F.concat(quoted, F.lit("(?:s|es|['’]s)?")))
        .otherwise(quoted)
    )
    alone = F.concat(F.lit("(?<![\\p{L}\\p{N}_])"), body, F.lit("(?![\\p{L}\\p{N}_])"))
    latin = target.rlike("^[\\x00-\\x7f]*$") & target.rlike("[A-Za-z0-9]")
    return F.when(latin, F.regexp_like(text, alone)).otherwise(F.contains(text, target))


def in_scope(scopes: Column, node: Column) -> Column:
    """Whether an entry holds for a node: it names no scope, the whole book, or the node."""
    return (F.coalesce(F.size(scopes), F.lit(0)) <= 0) | F.array_contains(scopes, "book") | F.coalesce(F.array_contains(scopes, node), F.lit(False))


def selected(texts: DataFrame, glossary: DataFrame, key: list[str], node: str, text: str = "text", status: str = "confirmed") -> DataFrame:
    """``key, id, n``: the confirmed entries in scope of each text's node that occur in it."""
    entries = glossary.where(F.col("status") == status).select("id", "scopes")
    found = matches(texts, glossary, key, text).join(entries, "id")
    nodes = texts.select(*key, F.col(node).alias("_node")).distinct()
    return found.join(nodes, key).where(in_scope(F.col("scopes"), F.col("_node"))).select(*key, "id", "n").distinct()


#: The fields of an entry that say what it means, in the order of canonical JSON.
MEANING = ("aliases", "category", "domain", "grammatical", "scopes", "source", "status", "target")


def entry_hash(glossary: DataFrame) -> Column:
    """SHA-256 of the entry's meaning as canonical JSON: sorted keys, no spaces; a missing field is null."""
    known = set(glossary.columns)
    fields = [F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in MEANING]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def newest(entries: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last of several versions of a row."""
    last = Window.partitionBy(*key).orderBy(*order)
    return entries.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
