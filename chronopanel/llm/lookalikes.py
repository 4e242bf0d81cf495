"""One consistent form of texts that look alike, by DuckDB expressions inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.sources.tables import cut

# Letters of other scripts, and marks, that look like the ones beside them.
CYRILLIC = ("АВЕКМНОРСТХЅІЈаеорсхуѕіјһԁԛԝёЁїЇ", "ABEKMHOPCTXSIJaeopcxysijhdqwëËïÏ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")
CHEROKEE = ("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᏀᏃᏔᏕᏙᏞᏟᏢᏦ", "DRTYAJEWMHGZWSVLCPK")
MARKS = ("‐‑․⁄∕∶ǃʼµ∙∣", "--.//:!’μ·|")
#: Characters that don't show, as classes of a regular expression; those of the Arabic and Mongolian
#: scripts and the variation selectors among them.
INVISIBLE = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
#: Compatibility forms that look like plain letters: ligatures, digraphs, Roman numerals, the ellipsis.
COMPATIBLE = [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), 0x2026]
#: Letters and digits of a mathematical style, beyond the first plane.
STYLED = range(0x1D400, 0x1D800)


def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Single characters and what they become; single characters that become several. Widths and spaces by rule."""
    one, many = [], []
    for cp in (*range(0x80, 0x10000), *STYLED):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch).partition(" ")[0]
        if kind in ("<wide>", "<narrow>") or cp in COMPATIBLE or (cp in STYLED and kind == "<font>"):
            to = unicodedata.normalize("NFKC", ch)
            (one if len(to) == 1 else many).append((ch, to))
        elif unicodedata.category(ch) == "Zs":
            one.append((ch, " "))
    one += [pair for table in (CYRILLIC, GREEK, CHEROKEE, MARKS) for pair in zip(*table, strict=True)]
    return "".join(a for a, _ in one), "".join(b for _, b in one), many


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """DuckDB expression of the consistent form of a column."""
    a, b, many = _tables()
    x = f"regexp_replace({column}, '\\r\\n|[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    x = f"regexp_replace({x}, '{INVISIBLE}', '', 'g')"
    x = f"regexp_replace({x}, '\\x{{AD}}(\\n|$)', '-\\1', 'g')"  # a soft hyphen shows at the end of a line alone
    x = f"replace({x}, chr(173), '')"
    x = f"translate({x}, {_quoted(a)}, {_quoted(b)})"
    hit = "[" + "".join(f"\\x{{{ord(c):X}}}" for c, _ in many) + "]"
    inner = x
    for c, to in many:
        inner = f"replace({inner}, {_quoted(c)}, {_quoted(to)})"
    # The long chain of replacements runs only where one of its characters is.
    x = f"CASE WHEN regexp_matches({column}, '{hit}') THEN {inner} ELSE {x} END"
    return f"nfc_normalize({x})"


def forms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, form of every row: its text in the one consistent form; null for null.

    Width of letters, kind of space, ligatures, invisible characters and the code of a letter or mark don't change the
    form; case, accents, raised digits, minus signs, Greek letters unlike Latin ones, line breaks and the number of spaces
    do. The form of a form is itself.
    """
    import duckdb  # noqa: F401 - missing it should fail here, not on the executors

    kinds = dict(df.dtypes)
    columns = ", ".join(f'"{c}"' for c in keep)
    sql = f"SELECT {columns}, {form_sql('_text')} AS form FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"}) as con:
            con.execute("SET preserve_insertion_order = true")
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "form string"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, shape)


#: Members of one class that one task pairs with another class.
SALTED = 2_000


def alike_pairs(df: DataFrame, key: str, text: str, scope: str | None = None) -> DataFrame:
    """id_1, id_2 (id_1 < id_2): rows of one scope whose texts have the same form but aren't the same characters.

    df has one row a key; rows with null text, null key or null scope have no pairs. Texts are compared by 128-bit hashes
    of form and characters. Only classes of the same characters are paired, then replaced by their members, so that no
    two copies of one text are ever compared: the work is that of the pairs that come out.
    """
    scoped = df.select(F.col(key).alias("_id"), F.col(text).alias("_t"), (F.col(scope) if scope else F.lit(0)).cast("string").alias("_scope")).where("_id is not null and _t is not null and _scope is not null")
    hashed = forms(scoped.withColumn("_raw", F.md5("_t")), "_t", "_id", "_scope", "_raw").select("_id", "_scope", "_raw", F.md5("form").alias("_form"))
    hashed = cut(hashed)  # every text goes through DuckDB once
    classes = hashed.groupBy("_scope", "_form", "_raw").agg(F.count("*").alias("n"))
    several = classes.groupBy("_scope", "_form").agg(F.count("*").alias("kinds")).where("kinds > 1").select("_scope", "_form")
    some = classes.join(several, ["_scope", "_form"], "left_semi")
    a = some.select("_scope", "_form", F.col("_raw").alias("_raw_a"))
    b = some.select("_scope", "_form", F.col("_raw").alias("_raw_b"), F.ceil(F.col("n") / SALTED).cast("int").alias("_slices"))
    pairs = a.join(b, ["_scope", "_form"]).where("_raw_a < _raw_b")
    left = hashed.select("_scope", "_form", F.col("_raw").alias("_raw_a"), F.col("_id").alias("_a"))
    slices = some.select("_scope", "_form", "_raw", F.ceil(F.col("n") / SALTED).cast("int").alias("_s"))
    right = hashed.join(slices, ["_scope", "_form", "_raw"]).select("_scope", "_form", F.col("_raw").alias("_raw_b"), F.col("_id").alias("_b"), F.pmod(F.xxhash64("_id"), F.col("_s")).cast("int").alias("_slice"))
    # Members of one class meet those of another in slices, so that two hot classes aren't one task.
    wide = pairs.join(left, ["_scope", "_form", "_raw_a"]).select("_scope", "_form", "_raw_b", "_a", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    both = wide.join(right, ["_scope", "_form", "_raw_b", "_slice"])
    return both.where("_a <> _b").select(F.least("_a", "_b").alias("id_1"), F.greatest("_a", "_b").alias("id_2"))
