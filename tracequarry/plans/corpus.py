"""Source files written from the events table, so that queries over code meet what documents lack.

Each event becomes a piece of C by its number; the pieces of a user, a thousand numbers at a
time, are a file. The same texts come from Spark and from SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import table

#: Pieces by event_id modulo their number; @e stands for event_id, @k for event_id modulo 7.
PIECES = [
    'int load@e(int n) {\n    char *name@k = getenv("HOME");\n    n = n + 1;\n    strcpy(dst, name@k);\n    return n;\n}',
    'int quiet@e(int n) {\n    char *name@k = getenv("HOME");\n    return n;\n}',
    'void on_signal@e(int sig) {\n    printf("%d", sig);\n    free(p@k);\n}\nvoid install@e(int n) {\n    signal(SIGINT, on_signal@e);\n}',
    "int walk@e(int n) {\n    return walk@e(n - 1) + n;\n}",
    "int count@e(int n) {\n    if (n < 1) return 0;\n    return count@e(n - 1) + n;\n}",
    "int size@e(int n) {\n    int need@k = padded((size_t) n);\n    unsigned room = need@k;\n    return room;\n}",
    "void drop@e(char *p@k) {\n    free(p@k);\n    log_line(p@k);\n    free(p@k);\n}",
    "void renew@e(char *p@k) {\n    free(p@k);\n    p@k = NULL;\n    use(p@k);\n    free(p@k);\n}",
    "void handle@e(char *input, int len) {\n    char *cmd@k = input;\n    system(cmd@k);\n    memcpy(dst, input, len);\n}",
    "int decode@e(int idx, int n) {\n    char *room = malloc(n * idx);\n    int x = table@k[idx];\n    return x;\n}",
    "int main_loop@e(int n) {\n    step@e(n);\n    return helper@e(n);\n}\nvoid step@e(int n) {\n    helper@e(n);\n}\nint helper@e(int n) {\n    return n + @k;\n}",
    "// free(p@k); system(input);\nint plain@e(int n) {\n    return n;\n}",
]


def event_files(spark, sf_dir) -> DataFrame:
    """(file, text) of the files written from events."""
    event = F.col("event_id")
    piece = F.get(F.array(*map(F.lit, PIECES)), (event % len(PIECES)).cast("int"))
    text = F.replace(F.replace(piece, F.lit("@e"), event.cast("string")), F.lit("@k"), (event % 7).cast("string"))
    name = F.concat(F.lit("gen-"), F.col("user_id").cast("string"), F.lit("-"), F.floor(event / 1000).cast("string"), F.lit(".c"))
    rows = table(spark, sf_dir, "events").where("event_id >= 0 and user_id is not null").select("event_id", name.alias("file"), text.alias("t")).distinct()
    # At most a thousand pieces a file.
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]), "\n").alias("text"))


_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PIECES) + "]"
FILES_SQL = f"""select file, string_split(string_agg(t, chr(10) order by event_id), chr(10)) as ls from (
  select distinct event_id, 'gen-' || user_id || '-' || (event_id // 1000) || '.c' as file,
    replace(replace({_LIST}[event_id % {len(PIECES)} + 1], '@e', cast(event_id as varchar)), '@k', cast(event_id % 7 as varchar)) as t
  from events where event_id >= 0 and user_id is not null) group by 1"""
