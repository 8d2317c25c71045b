"""Readers: JSON Lines with strict schemas, labelled text files, CSV archives, row adapters, and regulatory HTML."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from ..operators.joins import duplicates, first_wins

SEED = "ordinal long, source string, source_id string, text string, source_label string, content_hash string"


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, strict: bool = True) -> DataFrame:
    """JSON Lines of a fixed schema. Strict: unknown fields, repeated keys at any depth and non-finite numbers are errors; so are repeated keys of the table."""
    if strict:
        lines = spark.read.text(path).where(F.trim("value") != "")
        fields = F.array(*[F.lit(f.name) for f in T._parse_datatype_string(schema).fields])
        bad = lines.where(~X.strict_json_object(F.col("value")) | (F.size(F.array_except(F.json_object_keys("value"), fields)) > 0))
        if not bad.isEmpty():
            raise ValueError(f"a line of {path} is not a strict record")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key and not duplicates(rows, key).isEmpty():
        raise ValueError(f"repeated {key}")
    return rows


def canonical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines and whether each equals its own canonical form."""
    lines = spark.read.text(path)
    return lines.withColumn("canonical", lines.value.eqNullSafe(X.canonical_json()(F.col("value"))))


def seed_rows(rows: DataFrame, source: str, source_id: Column, text: Column, label: Column, ordinal: Column) -> DataFrame:
    """Seed records: normalised text, its hash, and the ordinal that first-wins rules need. Rows without usable text are left out."""
    made = rows.select(ordinal.cast("long").alias("ordinal"), F.lit(source).alias("source"), source_id.alias("source_id"), X.normalize_seed(text).alias("text"), label.alias("source_label"))
    return made.where("text is not null").withColumn("content_hash", X.content_hash(F.col("text")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers in the file, blank ones counted. Each file is read whole by one task, as numbers follow the file's order."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = content.decode("utf-8-sig", "strict") if _is_utf8(content) else content.decode("latin-1")
                lines = raw.splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], names=["path", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line long, value string")


def _is_utf8(content: bytes) -> bool:
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def labelled_lines(spark: SparkSession, path: str, source: str = "uci_sms_spam", most: int = 5000) -> DataFrame:
    """label<TAB>text lines; ids carry the physical line number."""
    parts = F.split("value", "\t", 2)
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return seed_rows(rows, source, F.format_string("sms-%06d", F.col("line")), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.col("line")).orderBy("ordinal").limit(most)


def safe_member(name: str) -> bool:
    """Whether an archive member's name stays inside the archive."""
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP archives as (member, content), in name order; unsafe names are errors."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if not n.endswith("/"))
                    if not all(map(safe_member, names)):
                        raise ValueError("unsafe member name")
                    for n in names:
                        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([z.read(n)], pa.binary())], names=["member", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, content binary")


def comment_rows(rows: DataFrame, source: str = "uci_youtube_spam") -> DataFrame:
    """CSV comments (file stem, row, COMMENT_ID, CONTENT, CLASS): spam iff CLASS is 1."""
    name = F.coalesce(F.when(F.trim("COMMENT_ID") != "", F.col("COMMENT_ID")), F.concat(F.lit("row-"), F.col("row").cast("string")))
    return seed_rows(rows, source, F.concat_ws(":", "stem", F.lpad(F.col("row").cast("string"), 6, "0"), name), F.col("CONTENT"), F.when(F.trim("CLASS") == "1", "spam").otherwise("ham"), F.col("row"))


def guard_rows(rows: DataFrame, source: str = "nemotron_aegis_v2") -> DataFrame:
    """Prompts with an optional response as one JSON text; withheld prompts are left out."""
    both = F.to_json(F.struct(X.normalize_seed(F.col("prompt")).alias("query"), X.normalize_seed(F.col("response")).alias("response")))
    text = F.when(F.col("response").isNotNull(), both).otherwise(F.col("prompt"))
    return seed_rows(rows.where("prompt <> 'REDACTED'"), source, F.col("id").cast("string"), text, F.lower("label"), F.col("ordinal"))


def toxicity_rows(rows: DataFrame, source: str = "civil_comments") -> DataFrame:
    """Comments with a toxicity of 0..1: toxic from one half; other values are errors of the input."""
    sound = F.col("toxicity").between(0, 1) & ~F.isnan("toxicity")
    label = F.when(F.col("toxicity") >= 0.5, "toxic").otherwise("non_toxic")
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("civil-row-"), F.lpad(F.col("ordinal").cast("string"), 9, "0")))
    return seed_rows(rows.withColumn("toxicity", F.when(sound, F.col("toxicity")).otherwise(F.raise_error(F.lit("toxicity must lie in 0..1")).cast("double"))), source, name, F.col("text"), label, F.col("ordinal"))


def query_rows(rows: DataFrame, source: str = "amazon_esci") -> DataFrame:
    """Training queries of one locale, the first of each canonical form; ids follow from that form."""
    picked = rows.where((F.lower("product_locale") == "us") & (F.col("split") == "train"))
    form = X.squeeze(X.nfkc_casefold(F.col("query")))
    first = first_wins(picked.withColumn("__form", form), "__form", "ordinal")
    return seed_rows(first, source, F.concat(F.lit("esci-query-"), F.substring(F.sha2("__form", 256), 1, 16)), F.col("query"), F.lit(None).cast("string"), F.col("ordinal"))


def union_seeds(parts: list[DataFrame], strict: bool = True) -> DataFrame:
    """All sources in order; a repeated (source, source_id) is an error, a repeated text keeps its first row."""
    placed = [df.withColumn("__at", F.lit(k)) for k, df in enumerate(parts)]
    rows = placed[0]
    for df in placed[1:]:
        rows = rows.unionByName(df)
    if strict and not duplicates(rows, "source", "source_id").isEmpty():
        raise ValueError("repeated source id")
    rows = rows.withColumn("__order", F.struct("__at", "ordinal"))
    return first_wins(rows, "content_hash", "__order").drop("__at", "__order")


class _Paragraphs(HTMLParser):
    """Texts of p and li elements, those inside article apart."""

    def __init__(self):
        super().__init__()
        self.skip = self.article = 0
        self.open: list[list[str]] = []
        self.all: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")
        self.article += tag == "article"
        if tag in ("p", "li"):
            self.open.append([])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript") and self.skip > 0
        if tag in ("p", "li") and self.open:
            text = " ".join("".join(self.open.pop()).split())
            self.all.append(text)
            if self.article:
                self.inside.append(text)
        self.article -= tag == "article" and self.article > 0

    def handle_data(self, data):
        if not self.skip:
            for parts in self.open:
                parts.append(data)


def page_cases(pages: DataFrame, id_col: str, html: str, least: int = 20, most: int | None = None) -> DataFrame:
    """Paragraphs of pages: those of an article if there is one, at least 20 characters long, each text once a page."""
    def run(batches):
        for batch in batches:
            out = []
            for i, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Paragraphs()
                parser.feed(markup or "")
                parser.close()
                texts = list(dict.fromkeys(t for t in parser.inside or parser.all if len(t) >= least))
                out += [(i, k, t) for k, t in enumerate(texts[:most])]
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c)], names=["page_id", "position", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(html)).mapInArrow(run, "page_id long, position int, text string")


def verified_artifacts(markers: DataFrame, metadata: DataFrame, raw: DataFrame) -> DataFrame:
    """Artifacts whose marker names the hashes of both its files: (digest, content, metadata)."""
    joined = markers.join(metadata.withColumnRenamed("content", "metadata"), "digest").join(raw, "digest")
    return joined.where((F.sha2("metadata", 256) == F.col("metadata_sha256")) & (F.sha2("content", 256) == F.col("raw_sha256")))


def scenario_rows(items: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """Scenario items by variant: SD, SD_TYPO and TYPO take their own prompt; a list of sampled ids restricts them."""
    kept = items.join(sampled.select("scenario", "item_id"), ["scenario", "item_id"], "left_semi") if sampled is not None else items
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("prompt")) for v, c in (("SD", "prompt_sd"), ("SD_TYPO", "prompt_sd_typo"), ("TYPO", "prompt_typo"))]))
    return kept.select("scenario", "item_id", variants.alias("v")).select("scenario", "item_id", "v.variant", "v.prompt")


def capped(rows: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first rows in order, and whether there were more."""
    head = rows.orderBy(*order).limit(most + 1)
    more = head.count() > most
    return head.limit(most) if more else head, more


def item_order(item_id: str) -> list[Column]:
    """Numeric ids first, in numeric order, then the others as text."""
    number = F.when(F.col(item_id).rlike("^[0-9]+$"), F.col(item_id).cast("decimal(38,0)"))
    return [number.isNull(), number, F.col(item_id)]


def governed(catalog: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Sources of a catalogue that may be used: enabled, or selected in order, and of an allowed licence."""
    allowed = catalog.where(F.col("license").isin(*P.LICENSES) & F.col("enabled"))
    if enabled is None:
        return allowed
    if len(set(enabled)) != len(enabled):
        raise ValueError("a source is selected twice")
    order = allowed.sparkSession.createDataFrame([(s, k) for k, s in enumerate(enabled)], "source string, position int")
    found = allowed.join(F.broadcast(order), "source")
    if found.count() != len(enabled):
        raise ValueError("a selected source is unknown, disabled or of another licence")
    return found.orderBy("position")
