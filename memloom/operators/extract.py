"""Rule-based extraction: every rule is a DataFrame of claims with character-level evidence.

The subject of each claim is the sender. Rules keep their order within a message (``rule``) and their hits' order
(``hit``), so a claim's place follows from (thread, message, rule, hit) and not from the engine.
Lexicons and patterns are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom import schemas
from memloom.functions.text import between, clamped, find_folded, person_name, spans, strip, title

from .scratch import Scratch

# Lexicons and patterns.
KNOWN_NAMES = (
    ("EnronOnline", "System"), ("EOL", "System"),
    ("Raptor", "FinancialInstrument"), ("LJM", "FinancialInstrument"), ("LJM2", "FinancialInstrument"), ("Chewco", "FinancialInstrument"),
    ("Whitewing", "FinancialInstrument"), ("JEDI", "FinancialInstrument"), ("Marlin", "FinancialInstrument"), ("Osprey", "FinancialInstrument"),
    ("Azurix", "Project"), ("Dabhol", "Project"), ("Death Star", "Project"), ("Fat Boy", "Project"), ("Get Shorty", "Project"),
    ("Blockbuster", "Organisation"), ("Arthur Andersen", "Organisation"), ("Andersen", "Organisation"), ("Vinson & Elkins", "Organisation"),
    ("Dynegy", "Organisation"), ("FERC", "Organisation"), ("SEC", "Organisation"), ("UBS Warburg", "Organisation"), ("Moody's", "Organisation"),
    ("S&P", "Organisation"), ("ChevronTexaco", "Organisation"), ("Weil Gotshal", "Organisation"),
)
KEYWORDS = (
    ("approved", "approved"), ("rejected", "rejected"), ("decided", "decided"), ("proposed", "proposed"), ("recommend", "proposed"),
    ("warned", "warned_about"), ("concerned", "warned_about"), ("investigating", "investigated"), ("resigned", "has_status"),
    ("terminated", "has_status"), ("filed", "has_status"), ("acquired", "acquired"), ("downgrade", "has_status"), ("bankruptcy", "has_status"),
)
LOCATIONS = ("Houston", "Portland", "London", "California", "New York", "India", "Brazil", "Argentina", "Maharashtra", "Mumbai")
MONEY = r"(?U)\$[\d,.]+[MBK]?\b"
TITLES = (
    r"(?iU)\b(?:CEO|CFO|COO|CRO|CAO|Treasurer|President|Chairman|Managing Director|Chief\s+\w+\s+Officer|Head\s+of\s+\w+"
    r"|VP\s+\w+|SVP\s+\w+|EVP\s+\w+|General Counsel)\b"
)
ROOT_ORGANISATION, ROOT_DOMAIN = "Enron", "enron.com"

CLAIM_COLUMNS = [
    "thread_id", "msg", "rule", "hit", "subject_name", "subject_type", "relation", "object_name", "object_type", "confidence",
    "source_id", "excerpt", "timestamp", "author", "subject", "char_offset_start", "char_offset_end", "valid_from",
]


def _claims(df: DataFrame, rule: int, relation: Column, object_name: Column, object_type: Column, confidence: float, excerpt: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select(
        "thread_id", F.col("seq").alias("msg"), F.lit(rule).alias("rule"), F.col("hit").cast("int").alias("hit"),
        person_name(F.col("sender")).alias("subject_name"), F.lit("Person").alias("subject_type"), relation.alias("relation"),
        object_name.alias("object_name"), object_type.alias("object_type"), F.lit(confidence).alias("confidence"),
        F.col("email_id").alias("source_id"), F.substring(excerpt, 1, schemas.EXCERPT_MAX).alias("excerpt"), F.col("ts_raw").alias("timestamp"),
        F.col("sender").alias("author"), F.col("subject"), (none if start is None else start.cast("int")).alias("char_offset_start"),
        (none if end is None else end.cast("int")).alias("char_offset_end"), F.col("ts_raw").alias("valid_from"),
    )


def recipient_type(address: Column) -> Column:
    low = F.lower(address)
    return F.when(F.contains(low, F.lit("all-")) | F.contains(low, F.lit("team")), "Organisation").otherwise("Person")


def recipients(messages: DataFrame) -> DataFrame:
    """One row per non-empty recipient, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce("recipients_raw", F.lit("")), ",", -1), strip), lambda r: r != "")
    return messages.select("*", F.posexplode(parts).alias("hit", "recipient"))


def sent_email(messages: DataFrame) -> DataFrame:
    each = recipients(messages)
    excerpt = F.concat(F.lit("Email from "), "sender", F.lit(" to "), "recipient", F.lit(" re: "), F.coalesce("subject", F.lit("")))
    return _claims(each, 1, F.lit("sent_email"), person_name(F.col("recipient")), recipient_type(F.col("recipient")), 1.0, excerpt)


def works_at(messages: DataFrame, domain: str = ROOT_DOMAIN, organisation: str = ROOT_ORGANISATION) -> DataFrame:
    own = messages.where(F.contains("sender", F.lit(domain))).withColumn("hit", F.lit(0))
    return _claims(own, 2, F.lit("works_at"), F.lit(organisation), F.lit("Organisation"), 0.95, F.concat(F.lit("Sender domain: "), "sender"))


def pattern_hits(messages: DataFrame, pattern: str, body: str = "body") -> DataFrame:
    """One row per match with its span; rows without a match go before anything is exploded."""
    found = messages.where(F.col(body).rlike(pattern)).withColumn("__spans", spans(F.col(body), pattern))
    return found.select("*", F.posexplode("__spans").alias("hit", "__s")).select("*", "__s.match", "__s.start", "__s.end").drop("__spans", "__s")


def has_value(messages: DataFrame, pattern: str = MONEY, reach: int = 80) -> DataFrame:
    hits = pattern_hits(messages, pattern)
    start, end = clamped(F.col("start") - reach, F.col("end") + reach, F.col("body"))
    return _claims(hits, 3, F.lit("has_value"), F.col("match"), F.lit("FinancialInstrument"), 0.85, strip(between(F.col("body"), start, end)), start, end)


def has_role(messages: DataFrame, pattern: str = TITLES) -> DataFrame:
    hits = pattern_hits(messages, pattern)
    start, end = F.greatest(F.lit(0), F.col("start") - 100), F.col("end") + 50
    return _claims(hits, 4, F.lit("has_role"), strip(F.col("match")), F.lit("Role"), 0.7, between(F.col("body"), start, end), start, end)


def lexicon_hits(messages: DataFrame, terms: list[tuple], names: list[str], body: str = "body") -> DataFrame:
    """One row per term that the body holds (any case, inside words too), with its first position.

    A lexicon is a small literal, so it is an array in the row's own expression; there is no join.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("hit"), *[F.lit(v).alias(n) for n, v in zip(names, t)]) for i, t in enumerate(terms)])
    low = F.lower(F.col(body))
    placed = F.transform(entries, lambda e: F.struct(e["hit"].alias("hit"), *[e[n].alias(n) for n in names], (F.position(F.lower(e[names[0]]), low) - 1).alias("at")))
    return messages.select("*", F.explode(F.filter(placed, lambda e: e["at"] >= 0)).alias("__e")).select("*", "__e.*").drop("__e")


def known_names(messages: DataFrame, lexicon: tuple = KNOWN_NAMES) -> DataFrame:
    hits = lexicon_hits(messages, list(lexicon), ["term", "kind"])
    start, end = clamped(F.col("at") - 40, F.col("at") + F.length("term") + 120, F.col("body"))
    return _claims(hits, 5, F.lit("related_to"), F.col("term"), F.col("kind"), 0.75, strip(between(F.col("body"), start, end)), start, end)


def keyword_events(messages: DataFrame, keywords: tuple = KEYWORDS) -> DataFrame:
    hits = lexicon_hits(messages, list(keywords), ["term", "rel"])
    start, end = clamped(F.col("at") - 60, F.col("at") + 120, F.col("body"))
    event = F.concat(title(F.col("term")), F.lit(" - "), F.substring(F.coalesce("subject", F.lit("")), 1, 50))
    return _claims(hits, 6, F.col("rel"), event, F.lit("Event"), 0.7, strip(between(F.col("body"), start, end)), start, end)


def locations(messages: DataFrame, places: tuple = LOCATIONS) -> DataFrame:
    hits = lexicon_hits(messages, [(p,) for p in places], ["term"])
    start, end = clamped(F.col("at") - 40, F.col("at") + 80, F.col("body"))
    return _claims(hits, 7, F.lit("related_to"), F.col("term"), F.lit("Location"), 0.6, strip(between(F.col("body"), start, end)), start, end)


def rule_claims(messages: DataFrame, *, domain: str = ROOT_DOMAIN, organisation: str = ROOT_ORGANISATION) -> DataFrame:
    """All rules' claims; ``messages`` are schemas.MESSAGE with thread_id.

    The seven rules read the messages through one written table, so the plan before them (threads, selection) runs once.
    """
    needed = messages.select("thread_id", "seq", "email_id", "sender", "recipients_raw", "subject", "ts_raw", "body")
    read = Scratch(messages.sparkSession, "rules").write(needed, "messages")
    out = sent_email(read)
    for part in (works_at(read, domain, organisation), has_value(read), has_role(read), known_names(read), keyword_events(read), locations(read)):
        out = out.unionByName(part)
    return out.select(*CLAIM_COLUMNS)


def rule_entities(messages: DataFrame, claims: DataFrame, organisation: str = ROOT_ORGANISATION) -> DataFrame:
    """Entities of each thread in order of first mention: the seeded organisation, senders, then the claims' ends.

    The first mention makes the entity and its first_seen; last_seen is the latest timestamp.
    """
    seed = messages.select("thread_id").distinct().select("thread_id", F.lit(-1).cast("long").alias("msg"), F.lit(-1).alias("rule"), F.lit(0).alias("hit"), F.lit(organisation).alias("name"), F.lit("Organisation").alias("type"), F.lit("").alias("ts"))
    senders = messages.select("thread_id", F.col("seq").alias("msg"), F.lit(0).alias("rule"), F.lit(0).alias("hit"), person_name(F.col("sender")).alias("name"), F.lit("Person").alias("type"), F.col("ts_raw").alias("ts"))
    objects = claims.select("thread_id", "msg", "rule", "hit", F.col("object_name").alias("name"), F.col("object_type").alias("type"), F.col("timestamp").alias("ts"))
    subjects = claims.select("thread_id", "msg", "rule", "hit", F.col("subject_name").alias("name"), F.col("subject_type").alias("type"), F.col("timestamp").alias("ts"))
    every = seed.unionByName(senders).unionByName(subjects).unionByName(objects).withColumn("key", F.concat("type", F.lit("::"), F.lower(strip(F.col("name")))))
    place = F.struct("msg", "rule", "hit", "name", "ts")
    made = every.groupBy("thread_id", "key", "type").agg(F.min(place).alias("first"), F.max("ts").alias("last_seen"))
    return made.select("thread_id", "key", "type", F.col("first.name").alias("name"), F.col("first.ts").alias("first_seen"), "last_seen", F.struct("first.msg", "first.rule", "first.hit").alias("place"))
