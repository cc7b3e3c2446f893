"""Registry, table access, and the derived rows with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.match import once
from flowtide.session import cut

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + sql_list(values)[1:-1] + ")"


def sql_any(text: str, parts, test: str = "contains") -> str:
    return "(" + " or ".join(f"{test}({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def pick(values, number: Column) -> Column:
    """values[number mod length]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_pick(values, number: str) -> str:
    return f"({sql_list(values)})[{number} % {len(values)} + 1]"


# --- parts as files ---------------------------------------------------------
FOLDERS = [
    "src/", "app/node_modules/lib/", "server/routes/", "web/src/api/users/[id]/", "pkg/vendor/", "src/tests/",
    "web/__tests__/", "web/components/", "web/src/app/", "srv/controllers/", "srv/data/static/", "lib/codefixes/",
    "out/dist/", "e2e/cypress/", "site/public/", "mobile/client/", "site/views/", "core/middleware/",
    "web/assets/private/", "tests/", "", "a/b/c/d/e/f/", "web/build/output/", "core/db.schema/",
]
ENDINGS = [
    ".js", ".ts", ".tsx", ".min.js", ".spec.ts", ".test.js", ".py", ".go", ".jsx", ".bundle.js", ".java",
    "/route.ts", "/gruntfile.js", "/vite.config.ts", ".txt", "/cypress.config.js", ".vue", ".tf", ".JS",
]


def file_path(name: Column, key: Column, size: Column) -> Column:
    return F.concat(
        pick(FOLDERS, size), F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), key.cast("string"),
        pick(ENDINGS, key),
    )


SQL_PATH = (
    f"({sql_pick(FOLDERS, 'p_size')} || replace(p_name, ' ', '-') || '-' || p_partkey"
    f" || {sql_pick(ENDINGS, 'p_partkey')})"
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, file_path) of every part, with p_name, p_size, p_brand."""
    part = read(spark, folder, "part")
    return part.select(
        "p_partkey", once(file_path(F.col("p_name"), F.col("p_partkey"), F.col("p_size"))).alias("file_path"),
        "p_name", "p_size", "p_brand", "p_type",
    )


SQL_FILES = f"files as (select p_partkey, {SQL_PATH} as file_path, p_name, p_size, p_brand, p_type from part)"

# --- line items as calls and flows ------------------------------------------
# Call target -> sink type expected for it (None: not sensitive).
TARGETS = {
    "db.query": "SINK_DATABASE",
    "console.log": None,
    "child_process.exec": "SINK_SHELL",
    "fs.readFileSync": "SINK_FILE",
    "axios.get": "SINK_NETWORK",
    "res.send": "SINK_XSS",
    "prisma.user.findFirst": "SINK_DATABASE",
    "JSON.parse": None,
    "User.createMany": "SINK_DATABASE",
    "items.filter": None,
    "db.insert": "SINK_DATABASE",
    "res.sendFile": "SINK_FILE",
    "forgot.reset": "SINK_NETWORK",
    "eval": "SINK_SHELL",
    "knex('users').select": "SINK_DATABASE",
    "Math.max": None,
    "db.update": "SINK_DATABASE",
    "fs.join+path": "SINK_FILE",
    "filesystem.open": "SINK_SHELL",
    "db.query.format": "SINK_DATABASE",
    "document.write": "SINK_XSS",
    "uniformMatrix4fv": None,
    "print": None,
    "repo.find": None,
    "logger.info": None,
}
SOURCES = [
    "SOURCE_HTTP_BODY", "SOURCE_URL_PARAM", "SOURCE_URL_QUERY", "SOURCE_SESSION", "SOURCE_ENV", "COOKIE",
    "AUTH_HEADER", "os.getenv('HOME')",
]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
SQL_LINE_ORDER = ", ".join(LINE_ORDER)


def target_of(part_key: Column, line_number: Column) -> Column:
    return pick(list(TARGETS), part_key + line_number)


SQL_TARGET = sql_pick(list(TARGETS), "(l_partkey + l_linenumber)")
SQL_SINK_TYPE = "case sink " + " ".join(
    f"when '{t.replace(chr(39), chr(39) * 2)}' then '{k}'" for t, k in TARGETS.items() if k
) + " end"


def sensitive_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line items whose call target is sensitive, with its kind and the file: what ``described`` cannot tell by itself."""
    from flowtide.functions import calls
    from flowtide.functions.match import keep_classified

    lines = read(spark, folder, "lineitem").select(
        *LINE_ORDER, "l_returnflag", "l_linestatus", target_of(F.col("l_partkey"), F.col("l_linenumber")).alias("sink"))
    # Classifying is the dear part, so each target once. Written, so that few targets are sent to the lines.
    kinds = cut(keep_classified(lines.select("sink").distinct(), "sink_type", calls.sink_type(F.col("sink"))), "kinds")
    parts = files(spark, folder).select(F.col("p_partkey").alias("l_partkey"), F.col("file_path").alias("file"))
    return lines.join(kinds, "sink").drop("sink").join(parts, "l_partkey").select(
        *LINE_ORDER, "l_returnflag", "l_linestatus", "sink_type", "file")


def described(lines: DataFrame) -> DataFrame:
    """Sensitive lines as flows: all columns that follow from the row itself."""
    flows = lines.withColumns({
        "source": pick(SOURCES, F.col("l_suppkey")), "sink": target_of(F.col("l_partkey"), F.col("l_linenumber")),
        "validated": F.col("l_returnflag") == "R",
        "operations": F.when(F.col("l_linestatus") == "O", F.array(F.lit("OP_COERCION")))
        .otherwise(F.array().cast("array<string>")),
    })
    labels = F.array("source", F.col("l_suppkey").cast("string"), F.col("sink"))
    return flows.select(
        *LINE_ORDER, "source", "sink", "sink_type", "validated", "operations", "file",
        F.col("l_linenumber").alias("line"), labels.alias("path_labels"),
        F.array(F.concat(F.lit("VAR_"), F.col("l_suppkey").cast("string"))).alias("expressions"),
        F.concat("file", F.lit("::"), "sink").alias("sink_fnid"),
        *[c for c in lines.columns if c == "id"],
    )


def raw_flows(spark: SparkSession, folder: str) -> DataFrame:
    """One flow per line item whose call target is sensitive, without ids."""
    return described(sensitive_lines(spark, folder))


SQL_FLOWS = f"""{SQL_FILES},
calls as (
  select {SQL_LINE_ORDER}, {sql_pick(SOURCES, 'l_suppkey')} as source, {SQL_TARGET} as sink,
         l_returnflag = 'R' as validated, l_linestatus = 'O' as coerced
  from lineitem
),
flows as (
  select c.*, {SQL_SINK_TYPE} as sink_type, f.file_path as file, l_linenumber as line
  from calls c join files f on f.p_partkey = c.l_partkey
  where {SQL_SINK_TYPE} is not null
)"""


def numbered_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The flows with ids, read from the table that the numbering has written."""
    from flowtide.operators.ordered import sequential_ids

    # Numbered before they are described: what follows from a row is neither sorted nor written.
    return described(sequential_ids(sensitive_lines(spark, folder), LINE_ORDER, "id", "flow-"))


SQL_NUMBERED = f"""{SQL_FLOWS},
numbered as (
  select *, 'flow-' || (row_number() over (order by {SQL_LINE_ORDER}) - 1) as id from flows
)"""
