"""Relation catalogue: argument types, relational words and knowledge-base sources of each relation."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Relational words.
FOUNDER_UNIGRAMS = ["founder", "co-founder", "cofounder", "co-founded", "cofounded", "founded", "founders"]
FOUNDER_BIGRAMS = ["started by"]
OWNS_UNIGRAMS = ["owns", "acquired", "bought", "acquisition"]
OWNS_BIGRAMS = ["has acquired", "which acquired", "was acquired", "which owns", "owned by"]
INSTALLATIONS_UNIGRAMS = ["headquarters", "headquartered", "offices", "office"]
INSTALLATIONS_BIGRAMS = [
    ", based in", "based in", "located in", "main office", "main offices", "offices in",
    "building in", "office in", "head office", "head offices",
]
AFFILIATION_UNIGRAMS = [
    "chief", "chairman", "executive", "ceo", "CEO", "employer", "president", "head", "administrator", "governor",
]
AFFILIATION_BIGRAMS = ["chief executive", "technical chief", "top executive"]
STUDIED_UNIGRAMS = ["graduated", "graduate"]
STUDIED_BIGRAMS = ["graduated from", "earned phd", "studied at", "student at", "graduated the"]
STUDIED2_WORDS = ["graduate", "phd", "doctorate", "master", "mba", "studied", "student"]
LOCATED_IN_UNIGRAMS = ["capital", "suburb", "city", "island", "region"]
LOCATED_IN_BIGRAMS = [
    "capital of", "suburb of", "city of", "island", "region of", "in southern", "in northern", "northwest of", "town in",
]
SPOUSE_UNIGRAMS = ["married", "wife", "husband"]
SPOUSE_BIGRAMS = ["married to", "his wife", "her husband"]

# Relations whose facts keep their argument order on passive voice.
KEEP_ORDER_ON_PASSIVE = ["owns2", "founder"]

# Fixed values: (rel_type, e1_type, e2_type, unigrams, bigrams in use, bigrams as declared).  The
# founder and owns families match their unigrams as bigrams too, which never fires; the declared
# lists are kept beside for callers that want them.
RELATIONS = [
    ("has-installations", "ORG", "LOC", INSTALLATIONS_UNIGRAMS, INSTALLATIONS_BIGRAMS, INSTALLATIONS_BIGRAMS),
    ("has-installations2", "LOC", "ORG", INSTALLATIONS_UNIGRAMS, INSTALLATIONS_BIGRAMS, INSTALLATIONS_BIGRAMS),
    ("founder", "ORG", "PER", FOUNDER_UNIGRAMS, FOUNDER_UNIGRAMS, FOUNDER_BIGRAMS),
    ("founder2", "PER", "ORG", FOUNDER_UNIGRAMS, FOUNDER_UNIGRAMS, FOUNDER_BIGRAMS),
    ("owns", "ORG", "ORG", OWNS_UNIGRAMS, OWNS_UNIGRAMS, OWNS_BIGRAMS),
    ("owns2", "ORG", "ORG", OWNS_UNIGRAMS, OWNS_UNIGRAMS, OWNS_BIGRAMS),
    ("affiliation", "ORG", "PER", AFFILIATION_UNIGRAMS, AFFILIATION_BIGRAMS, AFFILIATION_BIGRAMS),
    ("affiliation2", "PER", "ORG", AFFILIATION_UNIGRAMS, AFFILIATION_BIGRAMS, AFFILIATION_BIGRAMS),
    ("studied", "PER", "ORG", STUDIED_UNIGRAMS, STUDIED_BIGRAMS, STUDIED_BIGRAMS),
    ("studied2", "ORG", "PER", STUDIED2_WORDS, STUDIED2_WORDS, STUDIED2_WORDS),
    ("located-in", "LOC", "LOC", LOCATED_IN_UNIGRAMS, LOCATED_IN_BIGRAMS, LOCATED_IN_BIGRAMS),
    ("spouse", "PER", "PER", SPOUSE_UNIGRAMS, SPOUSE_BIGRAMS, SPOUSE_BIGRAMS),
]

# Which relations store a source's triples with subject and object exchanged.
SWAPPED_RELATIONS = {
    "freebase": ["founder", "affiliation", "owns2", "has-installations2"],
    "dbpedia": ["studied2", "founder2", "owns2", "has-installations2"],
    "yago": ["founder", "affiliation", "studied2", "owns2", "has-installations2"],
    "manual": [],
}
# Files that are exchanged whatever the relation.
SWAPPED_FILES = ["dbpedia_capital.txt", "dbpedia_largestCity.txt"]
# Relations stored in both directions (Freebase-style files only).
SYMMETRIC_RELATIONS = ["spouse"]

# File names per relation and source family.
INSTALLATION_FILES = {
    "freebase": ["freebase_place_founded.txt"],
    "dbpedia": ["dbpedia_location.txt", "dbpedia_headquarter.txt", "dbpedia_locationCity.txt", "dbpedia_locationCountry.txt"],
    "yago": ["yago_isLocatedIn.txt"],
}
FOUNDER_FILES = {"freebase": ["freebase_founded.txt"], "dbpedia": ["dbpedia_founder.txt"], "yago": ["yago_created.txt"]}
OWNS_FILES = {"freebase": ["freebase_acquired.txt"], "dbpedia": ["dbpedia_subsidiary.txt"], "yago": ["yago_owns.txt"]}
AFFILIATION_FILES = {
    "freebase": ["freebase_employment.txt", "freebase_governance.txt", "freebase_leader_of.txt"],
    "yago": ["yago_isAffiliatedTo.txt", "yago_worksAt.txt"],
}
STUDIED_FILES = {"dbpedia": ["dbpedia_almaMater.txt"], "yago": ["yago_graduatedFrom.txt"]}
KB_FILES = {
    "has-installations": {**INSTALLATION_FILES, "manual": ["manually_has-installations.txt"]},
    "has-installations2": {**INSTALLATION_FILES, "manual": ["manually_has-installations2.txt"]},
    "founder": {**FOUNDER_FILES, "manual": ["manually_founded.txt"]},
    "founder2": {**FOUNDER_FILES, "manual": ["manually_founded2.txt"]},
    "owns": {**OWNS_FILES, "manual": ["manually_owns.txt"]},
    "owns2": {**OWNS_FILES, "manual": ["manually_owns2.txt"]},
    "affiliation": {**AFFILIATION_FILES, "manual": ["manually_affiliation.txt"]},
    "affiliation2": {**AFFILIATION_FILES, "manual": ["manually_affiliation2.txt"]},
    "studied": {**STUDIED_FILES, "manual": ["manually_studied.txt"]},
    "studied2": {**STUDIED_FILES, "manual": ["manually_studied2.txt"]},
    "located-in": {
        "freebase": ["freebase_location_citytown.txt"],
        "dbpedia": ["dbpedia_country.txt", "dbpedia_capital.txt", "dbpedia_largestCity.txt"],
        "yago": ["yago_isLocatedIn.txt"],
    },
    "spouse": {
        "freebase": ["freebase_married_to.txt", "freebase_spouse_partner.txt"],
        "manual": ["manually_spouse.txt"],
    },
}

CATALOGUE_SCHEMA = (
    "rel_type string, e1_type string, e2_type string, unigrams array<string>, bigrams array<string>, "
    "bigrams_declared array<string>"
)


def check_relations(rel_types: Iterable[str]) -> list[str]:
    known = {r[0] for r in RELATIONS}
    wanted = list(rel_types)
    unknown = sorted(set(wanted) - known)
    if unknown:
        raise ValueError(f"unknown relation types: {unknown}")
    return wanted


def relation_catalogue(spark: SparkSession, rel_types: Iterable[str] | None = None) -> DataFrame:
    """One row per relation; twelve rows, so joins to it are broadcast."""
    wanted = check_relations(rel_types) if rel_types is not None else [r[0] for r in RELATIONS]
    return spark.createDataFrame([r for r in RELATIONS if r[0] in wanted], CATALOGUE_SCHEMA)


def argument_types(rel_types: Iterable[str] | None = None) -> list[tuple[str, str]]:
    wanted = check_relations(rel_types) if rel_types is not None else [r[0] for r in RELATIONS]
    return sorted({(r[1], r[2]) for r in RELATIONS if r[0] in wanted})


def is_swapped(family: str, file_name: str, rel_type: str) -> bool:
    return file_name in SWAPPED_FILES or rel_type in SWAPPED_RELATIONS[family]
