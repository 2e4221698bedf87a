"""Readers and writers: mail folders, thread files, staged tables with resume."""

from __future__ import annotations

import email
import email.policy
import email.utils
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import schemas

# Folders that are read first within a mailbox, in order.
FIRST_FOLDERS = ("sent", "_sent_mail", "sent_items", "inbox", "all_documents")
PARSED = "message_id string, in_reply_to string, refs array<string>, sender string, recipients_raw string, subject string, ts_raw string, body string, ok boolean"


def folder_rank(path: Column) -> Column:
    rank = F.lit(len(FIRST_FOLDERS))
    for i, name in reversed(list(enumerate(FIRST_FOLDERS))):
        rank = F.when(F.contains(path, F.lit(f"/{name}/")), i).otherwise(rank)
    return rank


def capped(files: DataFrame, mailbox: str, order: list[Column], most: int = schemas.MAILBOX_CAP) -> DataFrame:
    """The first ``most`` files of each mailbox by order."""
    w = Window.partitionBy(mailbox).orderBy(*order)
    return files.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def mail_files(spark: SparkSession, root: str, mailboxes: tuple[str, ...] = (), most: int = schemas.MAILBOX_CAP, least_bytes: int = schemas.FILE_MIN) -> DataFrame:
    """(path, mailbox, rn, content) of the chosen files; sizes and ranks are decided before any content is read."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(root.rstrip("/") + "/"), F.lit(""))
    listed = base.select("path", "length", tail.alias("rel")).where(F.col("length") > least_bytes).withColumn("mailbox", F.substring_index("rel", "/", 1))
    if mailboxes:
        listed = listed.where(F.col("mailbox").isin(*mailboxes))
    chosen = capped(listed, "mailbox", [folder_rank(F.concat(F.lit("/"), "rel")), F.col("path")], most)
    return base.select("path", "content").join(chosen.select("path", "rel", "mailbox", "rn"), "path")


def parse_mail(content: bytes) -> dict[str, object]:
    """One RFC 2822 message; ``ok`` is False where it cannot be parsed."""
    try:
        msg = email.message_from_bytes(content, policy=email.policy.compat32)
        parts = []
        for part in msg.walk():
            if part.get_content_type() == "text/plain" and not part.is_multipart():
                payload = part.get_payload(decode=True) or b""
                parts.append(payload.decode(part.get_content_charset() or "utf-8", "replace"))
        raw = str(msg.get("Date", "") or "")
        try:
            ts = email.utils.parsedate_to_datetime(raw).isoformat()
        except (TypeError, ValueError):
            ts = raw
        text = lambda h: str(msg.get(h, "") or "").strip()
        return {
            "message_id": text("Message-ID"), "in_reply_to": text("In-Reply-To"), "refs": text("References").split(), "sender": text("From"), "recipients_raw": text("To"),
            "subject": text("Subject"), "ts_raw": ts, "body": "".join(parts).strip(), "ok": True,
        }
    except Exception:
        return {"message_id": "", "in_reply_to": "", "refs": [], "sender": "", "recipients_raw": "", "subject": "", "ts_raw": "", "body": "", "ok": False}


def parsed_messages(files: DataFrame) -> DataFrame:
    """schemas.MESSAGE rows of mail files: the MIME decoding is the one Python step; gates and ids are native. Order is by path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pd.DataFrame([parse_mail(bytes(c)) for c in pdf["content"]], columns=["message_id", "in_reply_to", "refs", "sender", "recipients_raw", "subject", "ts_raw", "body", "ok"])
            yield pd.concat([pdf[["path", "rel", "mailbox", "rn"]].reset_index(drop=True), rows], axis=1)

    raw = files.mapInPandas(run, f"path string, rel string, mailbox string, rn int, {PARSED}")
    kept = raw.where("ok").where(F.length("body") >= schemas.BODY_MIN)
    seq = F.xxhash64("mailbox").bitwiseAND(F.lit((1 << 42) - 1)) * F.lit(1 << 20) + F.col("rn")
    return kept.select(
        seq.alias("seq"), F.substring(F.md5("rel"), 1, 12).alias("email_id"), "message_id", "in_reply_to", "refs", "sender", "recipients_raw", "subject", "ts_raw",
        F.col("ts_raw").try_cast("timestamp").alias("ts"), F.substring("body", 1, schemas.BODY_MAX).alias("body"),
    )


def read_maildir(spark: SparkSession, root: str, mailboxes: tuple[str, ...] = (), most: int = schemas.MAILBOX_CAP) -> DataFrame:
    return parsed_messages(mail_files(spark, root, mailboxes, most))


THREAD_JSON = "thread_id string, subject string, message_count long, participants array<string>, messages array<struct<email_id:string,message_id:string,in_reply_to:string,references:string,`from`:string,`to`:string,subject:string,timestamp:string,body:string>>"
FLAT_JSON = "email_id string, message_id string, in_reply_to string, references string, `from` string, `to` string, subject string, timestamp string, body string"


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads from JSON: lists of messages; the older flat form, a message per element, becomes threads of one."""
    both = spark.read.schema(THREAD_JSON + ", " + FLAT_JSON.replace("subject string, ", "")).option("multiLine", "true").json(path)
    return wrapped(both)


def wrapped(rows: DataFrame) -> DataFrame:
    """(thread_id, subject, message_count, participants, messages) of rows that may be single messages."""
    one = F.struct(*[F.col(c) for c in ("email_id", "message_id", "in_reply_to", "references", "from", "to", "subject", "timestamp", "body")])
    flat = F.col("messages").isNull()
    return rows.select(
        F.when(flat, F.concat(F.lit("flat_"), "email_id")).otherwise(F.col("thread_id")).alias("thread_id"), "subject",
        F.when(flat, 1).otherwise(F.size("messages")).cast("long").alias("message_count"), F.when(flat, F.array("from")).otherwise(F.col("participants")).alias("participants"),
        F.when(flat, F.array(one)).otherwise(F.col("messages")).alias("messages"),
    )


def thread_messages(threads: DataFrame) -> DataFrame:
    """schemas.MESSAGE rows with thread_id from nested threads."""
    each = threads.select("thread_id", F.posexplode("messages").alias("pos", "m"))
    key = F.xxhash64("thread_id").bitwiseAND(F.lit((1 << 42) - 1)) * F.lit(1 << 20)
    return each.select(
        "thread_id", (key + F.col("pos")).alias("seq"), "m.email_id", "m.message_id", "m.in_reply_to", F.filter(F.split(F.coalesce("m.references", F.lit("")), r"\s+"), lambda r: r != "").alias("refs"),
        F.col("m.from").alias("sender"), F.col("m.to").alias("recipients_raw"), "m.subject", F.col("m.timestamp").alias("ts_raw"), F.col("m.timestamp").try_cast("timestamp").alias("ts"), "m.body",
    )


def read_source(spark: SparkSession, maildir: str | None = None, threads: str | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """Messages from the first source that is given: a mail folder, a thread file, a table; else the sample threads."""
    if maildir:
        return read_maildir(spark, maildir)
    if threads:
        return thread_messages(read_threads(spark, threads))
    return thread_messages(sample_threads(spark)) if fallback is None else fallback


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not finished yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


class Stage:
    """Staged output in batches. A batch's tables are written first and its finished keys last; only batches with a
    complete key list are read, so what a killed run left half written is ignored and its keys are done again."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def batches(self) -> list[str]:
        """Names of the finished batches."""
        fs, done = self._fs(f"{self.path}/done")
        if not fs.exists(done):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(done))
        return [n for n in names if fs.exists(self._fs(f"{self.path}/done/{n}/_SUCCESS")[1])]

    def exists(self) -> bool:
        return bool(self.batches())

    def todo(self, work: DataFrame) -> DataFrame:
        return remaining(work, self.read("done"), self.key) if self.exists() else work

    def add(self, keys: DataFrame, **tables: DataFrame) -> None:
        """One batch: its tables, then the keys that are finished by it."""
        name = f"batch-{uuid.uuid4().hex[:12]}"
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{name}")
        keys.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.path}/done/{name}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{table}/{n}" for n in self.batches()])


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A written stage's rows; None where it is not there yet (pages show nothing then)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.json(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


# Our own small mailbox for trying things out without any files: topics, and who writes what in turn.
SAMPLE_PEOPLE = ("ines.moor@harbour.example", "tom.ravel@harbour.example", "uma.berg@harbour.example", "leo.finch@quay.example")
SAMPLE_TOPICS = ("Crane lease", "Night shift rota", "Dredging permit", "Customs system", "Berth four repair", "Insurance renewal", "Tug contract", "Fuel hedge", "Ferry timetable", "Warehouse fire drill", "Union talks", "Audit findings", "Container backlog", "Pilot training", "Quay extension")
SAMPLE_TURNS = (
    "I proposed on the {t} that we spend $1.2M and close the matter this month; the CFO wants the figures before the board meets.",
    "The President approved the {t} in principle, but I am concerned about the cost and recommend a second opinion from London.",
    "We filed the papers for the {t} today. The price is now $900K, and the Head of Operations decided to go on as planned.",
    "I warned about delays with the {t}: the supplier in Houston has terminated one contract, so dates may move again.",
    "Thanks to all. The {t} is done, the General Counsel has signed, and the remaining $75K will be paid on delivery.",
)


def sample_threads(spark: SparkSession) -> DataFrame:
    """Nested threads made by rule: one for each topic, a message for each turn, each an answer to the one before."""
    rows = []
    for i, topic in enumerate(SAMPLE_TOPICS):
        mails = []
        for j, text in enumerate(SAMPLE_TURNS):
            sender, to = SAMPLE_PEOPLE[(i + j) % len(SAMPLE_PEOPLE)], SAMPLE_PEOPLE[(i + j + 1) % len(SAMPLE_PEOPLE)]
            mails.append((f"s{i:02d}{j}", f"<s{i}.{j}@harbour.example>", f"<s{i}.{j - 1}@harbour.example>" if j else "", "", sender, to, topic if not j else f"Re: {topic}", f"2001-{i % 12 + 1:02d}-{j + 1:02d}T09:00:00", text.format(t=topic.lower())))
        rows.append((f"sample_{i:02d}", topic, len(mails), sorted({m[4] for m in mails}), mails))
    return spark.createDataFrame(rows, THREAD_JSON)
