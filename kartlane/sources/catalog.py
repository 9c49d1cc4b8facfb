"""Table catalog: names, keys, links and date columns of the retail schema.

The workload is defined on a 14-table retail star schema.  The catalog keeps
that metadata in one place and resolves each name to a lazy DataFrame: either
a real dataset (Parquet/CSV path, explicit schema, no inference) or a
stand-in derived by Spark from the driver's TPC-H-style tables (see
``kartlane.sources.standins``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartlane.session import shuffle_by_size

# ---------------------------------------------------------------------------
# Fixed values of the schema (must equal the surveyed workload's metadata).
# ---------------------------------------------------------------------------
TABLE_NAMES = [
    "sales", "sample_submission", "customers", "geography", "products",
    "promotions", "inventory", "web_traffic", "order_items", "orders",
    "payments", "reviews", "returns", "shipments",
]

DATE_COLUMNS: dict[str, list[str]] = {
    "reviews": ["review_date"],
    "sales": ["Date"],
    "web_traffic": ["date"],
    "customers": ["signup_date"],
    "inventory": ["snapshot_date"],
    "promotions": ["start_date", "end_date"],
    "sample_submission": ["Date"],
    "orders": ["order_date"],
    "returns": ["return_date"],
    "shipments": ["ship_date", "delivery_date"],
}

KEY_COLUMNS: dict[str, list[str]] = {
    "reviews": ["review_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
    "promotions": ["promo_id"],
    "orders": ["order_id"],
    "returns": ["return_id"],
}

# (left table, left column, right table, right column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "zip", "geography", "zip"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("shipments", "order_id", "orders", "order_id"),
    ("returns", "order_id", "orders", "order_id"),
    ("returns", "product_id", "products", "product_id"),
    ("reviews", "order_id", "orders", "order_id"),
    ("reviews", "product_id", "products", "product_id"),
    ("inventory", "product_id", "products", "product_id"),
]

# Spark schemas of the 14 tables: readers take them instead of inferring, and the
# SQL twins of the profiles are built from them.
SCHEMAS: dict[str, str] = {
    "sales": "Date date, Revenue double, COGS double",
    "customers": "customer_id bigint, zip bigint, city string, signup_date date, gender string, "
                 "age_group string, acquisition_channel string",
    "geography": "zip bigint, city string, region string, district string",
    "products": "product_id bigint, product_name string, category string, segment string, size string, "
                "color string, price double, cogs double",
    "inventory": "snapshot_date date, product_id bigint, stock_on_hand bigint, units_received bigint, "
                 "units_sold bigint, stockout_days bigint, days_of_supply double, fill_rate double, "
                 "stockout_flag int, overstock_flag int, reorder_flag int, sell_through_rate double, "
                 "product_name string, category string, segment string, year int, month int",
    "web_traffic": "date date, sessions bigint, unique_visitors bigint, page_views bigint, "
                   "bounce_rate double, avg_session_duration_sec double, traffic_source string",
    "order_items": "order_id bigint, product_id bigint, quantity bigint, unit_price double, "
                   "discount_amount double, promo_id string, promo_id_2 string",
    "orders": "order_id bigint, order_date date, customer_id bigint, zip bigint, order_status string, "
              "payment_method string, device_type string, order_source string",
    "payments": "order_id bigint, payment_method string, payment_value double, installments bigint",
    "reviews": "review_id string, order_id bigint, product_id bigint, customer_id bigint, "
               "review_date date, rating bigint, review_title string",
    "returns": "return_id string, order_id bigint, product_id bigint, return_date date, "
               "return_reason string, return_quantity bigint, refund_amount double",
    "shipments": "order_id bigint, ship_date date, delivery_date date, shipping_fee double",
    "promotions": "promo_id string, promo_name string, promo_type string, discount_value double, start_date date, "
                  "end_date date, applicable_category string, promo_channel string, stackable_flag int, "
                  "min_order_value double",
    "sample_submission": "Date date, Revenue double, COGS double",
}

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


_SHARED: dict[tuple, DataFrame] = {}   # of a session: derived tables by files and name


class Catalog:
    """Name -> lazy DataFrame, cached per name so plans share one scan node.

    ``raw(name)`` reads one driver Parquet table and normalises timestamps
    (which load as ``timestamp_ntz``) only where a stand-in asks for dates.
    ``table(name)`` returns one of the 14 retail tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str,
                 overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = dict(overrides or {})
        self._own = frozenset(overrides or ())
        self._replaced, self._seen = bool(overrides), None

    # -- driver tables -----------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise KeyError(f"Unknown source table {name!r}. Available tables: "
                           + ", ".join(sorted(DRIVER_TABLES)))
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            shuffle_by_size(self.spark, self._bytes(name))
        return self._raw[name]

    # -- retail tables -----------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """``read_table``: unknown names raise a KeyError listing the choices."""
        if name in self._tables:
            return self._tables[name]
        from kartlane.sources import standins
        builders: dict[str, Callable[[Catalog], DataFrame]] = standins.BUILDERS
        if name not in builders:
            raise KeyError(f"Unknown table {name!r}. Available tables: "
                           + ", ".join(sorted(builders)))
        df = builders[name](self)
        self._tables[name] = df
        return df

    def derived(self, name: str) -> bool:
        """Whether ``name`` is a stand-in of the driver's tables rather than a table of the catalog's own."""
        return name not in self._own

    def checkpointed(self, name: str) -> DataFrame:
        """``table(name)`` cut from its lineage, as ``shared``.  For small derived tables (the daily panel)
        that many downstream branches read: they scan the checkpoint instead of
        re-deriving it from the raw tables."""
        return self.shared(name, lambda: self.table(name))

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table written once to ``spark.checkpoint.dir`` and read from there ever after.

        Catalogs of one session over the same files share it: features, panels and
        out-of-fold predictions are made once for all queries.  The files' names, sizes and
        times are looked at when a catalog first asks; where one has changed, or the
        catalog has tables of its own, the table is made anew.
        """
        from kartlane.session import cut_lineage
        own = f"{name}@checkpoint"
        if own not in self._tables:
            key = None if self._replaced else (self.spark.sparkContext.applicationId, self.sf_dir, self._stamp(), name)
            if key is None:
                self._tables[own] = cut_lineage(build())
            else:
                if key not in _SHARED:
                    _SHARED[key] = cut_lineage(build())
                self._tables[own] = _SHARED[key]
        return self._tables[own]

    def _bytes(self, name: str) -> int:
        """Bytes of a driver table's file or folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def _stamp(self) -> tuple:
        """Name, size and time of every table's file or folder."""
        if self._seen is None:
            jvm = self.spark._jvm
            root = jvm.org.apache.hadoop.fs.Path(self.sf_dir)
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "*.parquet")) or []
            self._seen = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))
        return self._seen

    def derive(self, overrides: dict[str, DataFrame]) -> "Catalog":
        """A catalog whose named tables are replaced; everything built on them
        (facts, series) is rebuilt lazily from the replacements. Tables of its own stay."""
        child = Catalog(self.spark, self.sf_dir, {n: self._tables[n] for n in self._own} | overrides)
        child._raw = self._raw
        return child

    def load_all(self) -> dict[str, DataFrame]:
        """``load_all_tables``: every retail table as a lazy frame + temp view."""
        out = {}
        for name in TABLE_NAMES:
            df = self.table(name)
            df.createOrReplaceTempView(name)
            out[name] = df
        return out


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of the 14 tables from CSV (with a header) or Parquet files, by its schema: nothing is inferred."""
    if name not in SCHEMAS:
        raise KeyError(f"Unknown table {name!r}. Available tables: " + ", ".join(sorted(SCHEMAS)))
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.schema(SCHEMAS[name])
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


ROW = "_row"   # pseudo-column of rows whose fields do not fit the header at all


class Checked(tuple):
    """``(clean, bad)`` of a table, and ``counts``: ``(table_name, what, reason, rows)`` of both from a single reading.

    ``what`` is ``clean`` (always there, without a reason) or a fault's column.
    """

    counts: DataFrame


def read_checked(spark: SparkSession, name: str, path: str) -> Checked:
    """A CSV table's good rows by its schema, and ``(table_name, column, reason, value, line)`` of every fault.

    Every field is read as text and tried against its type. A row with a fault in any
    field is kept out of the clean frame; it has one row in the quarantine for each fault,
    or a single one of the column ``_row`` where the line has another number of fields
    than the table or quotes that do not end. Empty fields are null.
    """
    if name not in SCHEMAS:
        raise KeyError(f"Unknown table {name!r}. Available tables: " + ", ".join(sorted(SCHEMAS)))
    fields = spark.createDataFrame([], SCHEMAS[name]).schema.fields
    texts = ", ".join(f"`{f.name}` string" for f in fields) + ", _line string"
    raw = (spark.read.schema(texts).option("header", True).option("multiLine", True).option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path))
    # ISO dates and plain numbers alone: a cast would take "2020" for a date and "1e3" for a whole number
    shape = {"date": r"^\d{4}-\d{2}-\d{2}$", "bigint": r"^\s*[+-]?\d+\s*$", "int": r"^\s*[+-]?\d+\s*$"}
    typed, wrong, reasons, faults = {}, {}, {}, []
    for f in fields:
        kind, text = f.dataType.simpleString(), F.col(f"`{f.name}`")
        value = text.try_cast(f.dataType)
        fine = value.isNotNull()
        if kind in shape:
            fine = _usual(text, value, kind) | (text.rlike(shape[kind]) & fine)
            value = F.when(text.rlike(shape[kind]), value)
        typed[f.name] = value
        if kind != "string":
            wrong[f.name], reasons[f.name] = ~F.coalesce(text.isNull() | fine, F.lit(False)), f"not a {kind}"
            faults.append(F.when(wrong[f.name], F.struct(
                F.lit(f.name).alias("column"), F.lit(reasons[f.name]).alias("reason"), text.alias("value"))))
    broken = F.array(F.struct(F.lit(ROW).alias("column"), F.lit("fields").alias("reason"), F.lit(None).cast("string").alias("value")))
    own = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<struct<column:string,reason:string,value:string>>")
    found = F.when(F.col("_line").isNotNull(), broken).otherwise(own)
    # a row is judged by plain conditions, which Spark compiles; the list of its faults, which it does not, is made for odd rows alone
    odd = F.col("_line").isNotNull()
    for w in wrong.values():
        odd = odd | w
    clean = raw.where(~odd).select(*[typed[f.name].alias(f.name) for f in fields])
    line = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]))
    bad = (raw.where(odd).select(F.lit(name).alias("table_name"), F.explode(found).alias("_f"), F.coalesce("_line", line).alias("line"))
           .select("table_name", "_f.column", "_f.reason", "_f.value", "line"))
    out = Checked((clean, bad))
    out.counts = _counted(raw, name, wrong, reasons)
    return out


def _usual(text, value, kind: str):
    """Whether a text is of the usual form of its type, which is cheaper to see than a pattern: digits as they are written, or yyyy-mm-dd."""
    if kind == "date":  # of the forms that a cast takes, ``yyyy-mm-dd`` alone has ten characters, these dashes and a digit at its end
        return ((F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
                & F.substring(text, 10, 1).between("0", "9") & value.isNotNull())
    return value.cast("string") == text


def _counted(raw: DataFrame, name: str, wrong: dict, reasons: dict) -> DataFrame:
    """One pass over the rows: how many are clean, broken, or at fault in each column."""
    at = list(wrong)
    flags = raw.select(F.col("_line").isNotNull().alias("b"), *[wrong[c].alias(f"f{i}") for i, c in enumerate(at)])
    whole, none = ~F.col("b"), ~F.col("b")
    for i in range(len(at)):
        none = none & ~F.col(f"f{i}")
    sums = flags.agg(F.count_if(none).alias("clean"), F.count_if("b").alias("b"), *[F.count_if(whole & F.col(f"f{i}")).alias(f"f{i}") for i in range(len(at))])
    rows = [("clean", None, "clean"), (ROW, "fields", "b"), *[(c, reasons[c], f"f{i}") for i, c in enumerate(at)]]
    cells = [F.struct(F.lit(w).alias("what"), F.lit(r).cast("string").alias("reason"), F.col(n).alias("rows")) for w, r, n in rows]
    return (sums.select(F.explode(F.array(*cells)).alias("c")).where("c.what = 'clean' or c.rows > 0")
            .select(F.lit(name).alias("table_name"), "c.what", "c.reason", "c.rows"))


def external(spark: SparkSession, root: str, fmt: str = "csv") -> Catalog:
    """A catalog over the files ``root/<table>.<fmt>`` of the retail schema instead of the driver's tables."""
    tables = {n: read_table(spark, n, f"{root.rstrip('/')}/{n}.{fmt}", fmt) for n in TABLE_NAMES}
    tables["orders_slim"] = tables["orders"].drop("zip")
    return Catalog(spark, root, tables)
