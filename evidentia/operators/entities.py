"""Entities by gazetteer and patterns: persons, organisations, locations, dates, numbers, concepts.

A deterministic stand-in for a trained tagger; see backends for the hook.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as T

# Known locations, nouns that are no person, words of political concepts.
LOCATIONS = [
    "mumbai", "delhi", "bengaluru", "bangalore", "chennai", "hyderabad", "kolkata", "pune", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur", "patna",
    "indore", "thane", "bhopal", "visakhapatnam", "pimpri", "nashik", "vadodara", "faridabad", "ghaziabad", "ludhiana", "agra", "meerut", "rajkot", "varanasi",
    "srinagar", "amritsar", "allahabad", "uttar pradesh", "maharashtra", "gujarat", "rajasthan", "bihar", "kerala", "karnataka", "andhra pradesh", "telangana", "punjab",
    "west bengal", "odisha", "assam", "jharkhand", "haryana", "himachal pradesh", "india", "pakistan", "china", "usa", "uk", "russia", "ukraine", "new delhi",
    "new york", "washington", "london", "beijing",
]
MORE_LOCATIONS = [
    "paris", "texas", "berlin", "tokyo", "california", "france", "germany", "spain",
]
NO_PERSON = [
    "citizens", "people", "voters", "workers", "students", "farmers", "protesters", "activists", "officials", "authorities", "residents", "journalists", "soldiers",
    "troops", "police", "government", "public", "nation", "everyone", "nobody", "someone", "anyone", "children", "women", "men", "youth", "seniors", "migrants",
]
CONCEPTS = [
    "opposition", "ruling", "party", "voter", "electoral", "roll", "revision", "government", "election", "commission", "parliament", "assembly", "legislature", "court",
    "tribunal", "ministry", "warehouse", "fire", "sector",
]
TITLES = [
    "President", "Senator", "Minister", "Governor", "Mayor", "Judge", "Justice", "General", "Mr", "Mrs", "Ms", "Dr",
]
ORG_ENDINGS = [
    "Inc", "Ltd", "Corp", "Corporation", "Company", "Commission", "Ministry", "Party", "University", "Bank", "Agency", "Council",
]
KNOWN_ORGS = [
    "Tesla", "Reuters", "Google", "Microsoft", "Apple", "Amazon", "Meta", "Twitter", "BBC", "NASA", "WHO", "UNESCO",
]
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]

NAME = r"\p{Lu}[\p{L}'\-]+"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(c, lambda x: x != "")))


def _known(names: list[str]) -> str:
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


def locations(text: Column) -> Column:
    """Known locations in the text's own spelling."""
    return _set(_all(text, rf"(?i)\b(?:{_known(LOCATIONS + MORE_LOCATIONS)})\b"))


def organisations(text: Column) -> Column:
    found = F.concat(_all(text, rf"\b(?:{NAME} )*(?:{_known(ORG_ENDINGS)})\b"), _all(text, rf"\b(?:{_known(KNOWN_ORGS)})\b"))
    return _set(F.filter(found, lambda o: ~F.lower(o).isin(LOCATIONS)))


def persons(text: Column) -> Column:
    """Names after a title, and pairs of capitalised words that no other kind claims."""
    titled = _all(text, rf"\b(?:{_known(TITLES)})\.? ({NAME}(?: {NAME})?)", 1)
    pairs = F.filter(_all(text, rf"\b{NAME} {NAME}\b"), lambda p: ~F.substring_index(p, " ", 1).isin(TITLES + MONTHS + ["The", "A", "An", "In", "On", "At", "By"]))
    taken = F.concat(organisations(text), locations(text))
    plain = F.filter(pairs, lambda p: ~F.exists(taken, lambda t: F.contains(p, t)))
    return _set(F.filter(F.concat(titled, plain), lambda p: ~F.lower(p).isin(NO_PERSON)))


def dates(text: Column) -> Column:
    month = _known(MONTHS)
    return _set(F.concat(_all(text, rf"\b(?:[0-9]{{1,2}} )?(?:{month})(?: [0-9]{{1,2}})?(?:,? (?:19|20)[0-9]{{2}})?\b"), _all(text, r"\b(?:19|20)[0-9]{2}\b")))


def numbers(text: Column) -> Column:
    """Amounts of money, percentages, large units and every standalone number."""
    unit = r"(?:\s+(?:crore|lakh|million|billion))"
    figure = r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?"
    return _set(F.concat(_all(text, rf"[$₹€£]\s?{figure}{unit}?"), _all(text, rf"\b{figure}\s?%"), _all(text, rf"\b{figure}{unit}"), T.standalone_numbers(text)))


def concepts(text: Column) -> Column:
    """Sector numbers, collective nouns and political words with the word before them, without determiners."""
    words = _known(CONCEPTS)
    near = F.transform(_all(text, rf"(?i)\b(?:[\p{{L}}]+ )?(?:{words})\b"), lambda x: F.regexp_replace(x, r"(?i)^(?:the|a|an|this|that|these|those|of|in|on|by|and|for|to) ", ""))
    return _set(F.concat(_all(text, r"(?i)\bsector\s*[0-9]+"), near))


def entities(c: Column) -> Column:
    """struct of six sorted lists."""
    t = T.text(c)
    return F.struct(persons(t).alias("persons"), organisations(t).alias("orgs"), locations(t).alias("locations"), dates(t).alias("dates"), numbers(t).alias("numbers"), concepts(t).alias("concepts"))
