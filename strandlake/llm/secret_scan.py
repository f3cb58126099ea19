"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more key-like characters that hold a digit, and values of 8 or more characters of any kind
that a word like `password` is assigned (`=`, `:` or `Bearer`). A forest of decision trees, trained from labelled
findings, judges each by its length, its character transitions, how much of it dictionary words cover, the path it was
found at and its neighbouring words. Candidates, features and scores are DataFrame expressions and JVM model code.

Labelled findings are a table (value, before, after, path, label); where a caller has none, `labelled_findings` makes a
bounded one by rule. Defined cases: null and empty texts have no candidate; whole texts are searched, and a value of any
length is one candidate; a value that is found both ways is one candidate; null paths and missing neighbours count as
empty; repeated rows and values are separate findings; a score at the threshold counts as a secret; an empty table gives
an empty result; input columns may have any name, and other columns than id, text and path are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9+/=_-]{16,}"
#: Names that secrets are assigned to; the end of what stands before an assigned value; an assignment within a word.
NAMES = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
LEAD = rf"(?i)(?:{NAMES}[A-Za-z0-9_.-]{{0,40}}[\"']? ?(?:[:=]{{1,2}}>?)|\bbearer)$"
WITHIN = rf"(?i){NAMES}[A-Za-z0-9_.-]{{0,40}}[\"']?[:=]{{1,2}}>?[\"'`]?([^\s\"'`<>]{{8,}})"
VALUE = r"^[\"'`(]{0,2}([^\s\"'`<>]{8,})"
#: Labelled findings that `labelled_findings` makes.
FINDINGS = 6000
TREES, DEPTH = 24, 7
#: Words whose presence in a value speaks for a name or a placeholder, words before a secret, words before
#: a harmless digest or number, and parts of paths where keys are samples.
DICTIONARY = (
    "account", "address", "admin", "amount", "article", "back", "button", "cache", "category", "change", "class", "client", "code", "color",
    "commit", "config", "content", "count", "data", "date", "default", "demo", "device", "dummy", "error", "example", "field", "file", "form",
    "forward", "group", "handler", "header", "here", "image", "index", "insert", "item", "key", "label", "level", "list", "message", "method",
    "model", "module", "name", "number", "object", "order", "page", "parent", "path", "placeholder", "point", "position", "product", "project",
    "query", "report", "request", "result", "sample", "section", "server", "service", "session", "size", "state", "status", "string", "style",
    "system", "table", "target", "test", "text", "time", "title", "token", "type", "update", "user", "value", "version", "view", "your",
)
SECRET_WORDS = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|private|auth|bearer|credential|cred|signing|key"
HARMLESS_WORDS = "sha1|sha256|sha|md5|commit|revision|rev|checksum|digest|hash|integrity|uuid|guid|etag|build|version|order|invoice|phone|card|isbn"
SAMPLE_PATHS = "test|example|sample|fixture|doc|readme|demo|mock|vendor|node_modules"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|rk_live_|xoxb-|xoxp-|AIza|eyJ|SG"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, word (its place), value, before, after, path (empty without a path column)."""
    text = F.col(text_col)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    wanted = text.rlike(RUN) | text.rlike(f"(?i){NAMES}|bearer")
    some = docs.filter(wanted).select(F.col(id_col).alias("doc_id"), path.alias("path"), F.split(text, r"\s+").alias("w"))
    none = F.array(F.lit(""))
    rows = F.arrays_zip(
        F.col("w").alias("w"),
        F.concat(none, "w").alias("b1"),
        F.concat(none, none, F.col("w")).alias("b2"),
        F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), none).alias("a1"),
        F.sequence(F.lit(0), F.size("w") - 1).alias("at"),
    )
    lead_of = lambda x: F.concat_ws(" ", x["b2"], x["b1"])
    # Most words are shorter than any value, so their neighbours are never looked at.
    likely = lambda x: (F.length(x["w"]) >= 8) & (x["w"].rlike(RUN) | x["w"].rlike(WITHIN) | lead_of(x).rlike(LEAD))
    held = some.select("doc_id", "path", F.explode(F.filter(rows, likely)).alias("c"))
    runs = F.filter(F.expr(f"regexp_extract_all(c.w, r'{RUN}', 0)"), lambda v: v.rlike("[0-9]"))
    inside = F.regexp_extract("c.w", WITHIN, 1)
    told = F.when(inside != "", inside).when(F.concat_ws(" ", "c.b2", "c.b1").rlike(LEAD), F.regexp_extract("c.w", VALUE, 1)).otherwise(F.lit(""))
    told = F.regexp_replace(told, r"[;,.)\]}]+$", "")
    assigned = F.when(F.length(told) >= 8, F.array(told)).otherwise(F.array().cast("array<string>"))
    values = held.select("doc_id", "path", "c", F.explode(F.concat(runs, F.array_except(assigned, runs))).alias("value"))
    lead = F.expr("substring_index(c.w, value, 1)")
    before = F.concat_ws(" ", "c.b2", "c.b1", lead)
    return values.select(
        "doc_id",
        F.col("c.at").cast("long").alias("word"),
        "value",
        F.right(before, F.lit(80)).alias("before"),
        F.substring(F.concat_ws(" ", F.expr("substring_index(c.w, value, -1)"), "c.a1"), 1, 40).alias("after"),
        "path",
    )


def _kept(value: Column, pattern: str) -> Column:
    """Length of what a pattern matches in a value."""
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with the forest's inputs, and their names."""
    v, low = F.col("value"), F.lower("value")
    n = F.length(v).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0")
    sounds = F.regexp_replace(F.regexp_replace(low, "[aeiouy]", "v"), "[b-df-hj-np-tv-xz]", "c")
    runs = F.regexp_replace(v, r"(.)\1+", "$1")
    before, after, path = F.lower("before"), F.lower("after"), F.lower("path")
    made = {
        "f_length": n,
        "f_is_hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "f_is_number": v.rlike("^[0-9_-]+$").cast("double"),
        "f_is_uuid": v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "f_digits": _kept(v, "[0-9]") / n,
        "f_uppers": _kept(v, "[A-Z]") / n,
        "f_lowers": _kept(v, "[a-z]") / n,
        "f_marks": _kept(v, "[^A-Za-z0-9]") / n,
        "f_kind_changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "f_sound_changes": (F.length(F.regexp_replace(sounds, r"(.)\1+", "$1")) - 1) / n,
        "f_clusters": _kept(low, "[bcdfghjklmnpqrstvwxz]{4,}") / n,
        "f_repeats": 1 - F.length(runs) / n,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)),
        "f_ladder": _kept(low, "0123|1234|2345|3456|4567|5678|6789|abcd|bcde|cdef|xxxx|0000") / n,
        "f_dictionary": _kept(low, "|".join(DICTIONARY)) / n,
        "f_prefix": v.rlike(f"^({PREFIXES})").cast("double"),
        "f_secret_word": before.rlike(SECRET_WORDS).cast("double"),
        "f_harmless_word": before.rlike(HARMLESS_WORDS).cast("double"),
        "f_assigned": before.rlike("[=:][ >]*[\"']?$|bearer $").cast("double"),
        "f_reference": v.rlike("[(<>{}*\\[\\]]").cast("double"),
        "f_quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "f_sample_word": F.concat_ws(" ", before, after).rlike("example|sample|dummy|placeholder|fake|test").cast("double"),
        "f_sample_path": path.rlike(SAMPLE_PATHS).cast("double"),
    }
    return rows.withColumns({k: F.coalesce(x.cast("double"), F.lit(0.0)) for k, x in made.items()}), list(made)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings made by rule, about half secrets: (value, before, after, path, label). `n` bounds the table."""
    hexes = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    more = F.sha2(F.concat(F.lit("second"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, more))), "[^A-Za-z0-9]", "x")
    letters = F.translate(hexes, "0123456789abcdef", "qhzkwtnvbxjdfmrp")
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (draw(k, len(xs)) + 1).cast("int"))
    words = [x for x in DICTIONARY if len(x) > 3]
    name = lambda a, b, sep: F.concat(pick(a, words), F.lit(sep), pick(b, words), F.lit(sep), pick(a + b, words), draw(7, 1000).cast("string"))
    phrase = lambda a, sep: F.concat(pick(a, words), F.lit(sep), pick(a + 30, words))
    password = F.concat(F.initcap(F.substring(letters, 1, 4)), pick(18, list("!#$%&@*")), F.substring(hexes, 9, 3), pick(19, list("!?#+=")), F.substring(mixed, 5, 4))
    digest = pick(1, [F.substring(hexes, 1, 40), F.substring(hexes, 1, 32), hexes, F.upper(F.substring(hexes, 1, 40))])
    secret = pick(
        2,
        [
            digest, digest, F.substring(mixed, 1, 40), F.substring(mixed, 3, 24), F.substring(letters, 1, 24), password, F.substring(password, 1, 10),
            F.concat(F.substring(mixed, 1, 27), F.lit("==")), F.concat(F.substring(mixed, 1, 11), F.lit("/"), F.substring(mixed, 12, 11), F.lit("+"), F.substring(mixed, 23, 14)),
        ],
    )
    marked = pick(
        3,
        [
            F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(mixed, "089", "QRS"), 5, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 2, 36)),
            F.concat(F.lit("sk_live_"), F.substring(mixed, 9, 24)), F.concat(F.lit("eyJ"), F.substring(mixed, 1, 60)), F.concat(F.lit("xoxb-"), F.substring(mixed, 9, 40)),
        ],
    )
    uuid = F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = F.conv(F.substring(hexes, 1, 13), 16, 10)
    #: What is harmless wherever it stands, and what is so only without a secret's words before it.
    tame = pick(
        4,
        [
            name(2, 3, "_"), name(3, 4, "-"), name(4, 5, "/"), phrase(8, ""), phrase(9, "_"), phrase(10, "-"), F.concat(name(6, 2, ""), F.lit("Handler")), number,
            F.concat(F.lit("your-"), pick(5, ["api-key", "token", "secret"]), F.lit("-here-1234")), F.lit("xxxxxxxxxxxxxxxxxxxx1234"), F.lit("********"), F.lit("<password>"),
            F.concat(F.lit("${"), F.upper(phrase(11, "_")), F.lit("}")), F.concat(F.lit("os.environ["), phrase(12, "_")), F.substring(F.repeat(F.lit("1234567890"), 4), 1, 20), F.concat(F.lit("get"), F.initcap(phrase(13, " ")), F.lit("()")),
        ],
    )
    told = pick(21, [
        "password = \"", "passwd: ", "pwd=", "DB_PASSWORD=", "secret: '", "client_secret\": \"", "api_key=", "apikey: \"", "x-api-key: ", "aws_secret_access_key = ",
        "Authorization: Bearer ", "auth_token = '", "export API_TOKEN=", "access token: ", "private_key: ", "signing credential = ",
    ])
    plain = pick(22, [
        "commit ", "sha256: ", "md5 = ", "integrity=\"", "see ", "the file ", "class=\"", "id: ", "checksum: ", "revision ", "href=\"/", "order number ", "uuid: \"", "build ", "and then ", "",
    ])
    kind = draw(20, 20)
    rows = spark.range(n).withColumns({"k": kind, "told": told, "plain": plain, "tame": tame, "marked": marked, "secret": secret, "loose": pick(23, [digest, uuid, number])})
    k = F.col("k")
    value = F.when(k < 8, F.col("secret")).when(k < 10, F.col("marked")).when(k < 15, F.col("tame")).otherwise(F.col("loose"))
    label = (k < 10).cast("double")
    near = F.when(k < 9, F.col("told")).when(k < 10, F.col("plain")).when(k < 13, F.col("told")).otherwise(F.col("plain"))
    path = F.when((label == 0) & (draw(14, 3) == 0), pick(15, ["docs/example.md", "tests/fixtures/a.json", "README.md"])).otherwise(pick(16, ["app/settings.py", "notes", "deploy/prod.env", "web"]))
    return rows.select(value.alias("value"), near.alias("before"), pick(17, ["\"", "'", "", "\" and", ";", ")"]).alias("after"), path.alias("path"), label.alias("label"))


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 23) -> RandomForestClassificationModel:
    """A forest from labelled findings, a bounded table."""
    rows, names = features(labelled)
    inputs = VectorAssembler(inputCols=names, outputCol="inputs").transform(rows).select("inputs", "label")
    return RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7).fit(inputs)


def score_candidates(candidates: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """The candidates with score, the share of the forest that calls them secrets."""
    rows, names = features(candidates)
    inputs = VectorAssembler(inputCols=names, outputCol="inputs").transform(rows).drop(*names)
    judged = model.setFeaturesCol("inputs").transform(inputs)
    return judged.withColumn("score", vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, word, value, value_sha256, before, after, path, score, is_secret."""
    model = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    scored = score_candidates(find_candidates(docs, id_col, text_col, path_col), model)
    return scored.withColumns({"value_sha256": F.sha2("value", 256), "is_secret": F.col("score") >= threshold})
