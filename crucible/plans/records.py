"""Sources, sinks and record reshaping on the driver's tables: rows are put into files of the library's shapes and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible import schemas
from crucible.functions import molecules, text
from crucible.operators import metrics, reshape, rollup
from crucible.plans.registry import Tables, big, query, rounded
from crucible.scratch import scratch_path
from crucible.sources import logfiles, readers, writers
from crucible.streaming import streams

S = F.col


def nothing() -> Column:
    return F.lit(None).cast("string")


def put(t: Tables, df: DataFrame, run: str, name: str, suffix: str = ".json") -> str:
    """A folder with a JSON file for each row: ``run``/``name`` + suffix, from columns of these names."""
    path = scratch_path(t.spark, "files")
    df.write.partitionBy(run, name).json(path)
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for found in store.globStatus(hadoop.Path(f"{path}/*/*/part-*.json")):  # a file a nation: some dozens
        folder = found.getPath().getParent()
        to = hadoop.Path(hadoop.Path(f"{path}-named", folder.getParent().getName().split("=", 1)[1]), folder.getName().split("=", 1)[1] + suffix)
        store.mkdirs(to.getParent())
        store.rename(found.getPath(), to)
    return f"{path}-named"


def places(t: Tables) -> DataFrame:
    return t.nation.join(t.region, S("n_regionkey") == S("r_regionkey"))


def species(smiles: Column, label: Column | None = None) -> Column:
    return F.struct(smiles.alias("smiles"), (label if label is not None else nothing()).alias("label"), F.lit(None).cast("boolean").alias("uncertain"))


def condition(role: Column, words: Column, smiles: Column | None = None) -> Column:
    return F.struct(role.alias("role"), words.alias("text"), (smiles if smiles is not None else nothing()).alias("smiles"), F.lit(None).cast("double").alias("raw_value"))


# --- sources


@query("SELECT n_name AS file_name, 'n' || n_nationkey AS stem, r_name AS run, s_suppkey || '_1' AS reaction_id, s_name AS reactant, round(s_acctbal) AS amount FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def read_records(t: Tables) -> DataFrame:
    one = F.struct(F.concat(S("s_suppkey").cast("string"), F.lit("_1")).alias("reaction_id"), F.array(species(S("s_name"))).alias("reactants"), F.array(condition(F.lit("time"), nothing()).withField("raw_value", F.round("s_acctbal"))).alias("conditions"))
    rows = places(t).join(t.supplier, S("s_nationkey") == S("n_nationkey")).groupBy(S("r_name").alias("run"), F.concat(F.lit("n"), "n_nationkey").alias("name")).agg(F.first("n_name").alias("file_name"), F.collect_list(one).alias("reactions"))
    got = readers.read_records(t.spark, put(t, rows, "run", "name"))
    return got.select("file_name", "stem", "run", F.explode("reactions").alias("r")).select("file_name", "stem", "run", "r.reaction_id", S("r.reactants")[0]["smiles"].alias("reactant"), S("r.conditions")[0]["raw_value"].alias("amount"))


@query("SELECT 'n' || n_nationkey AS stem, r_name AS run, n_name AS caption FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_extractions(t: Tables) -> DataFrame:
    rows = places(t).select(S("r_name").alias("run"), S("n_name").alias("figure_caption"), F.explode(F.transform(F.array(*map(F.lit, ("", "_insight", ".original", ".meta"))), lambda s: F.concat(F.lit("n"), "n_nationkey", s))).alias("name"))
    return readers.read_extractions(t.spark, put(t, rows, "run", "name")).select("stem", "run", S("figure_caption").alias("caption"))


@query("SELECT 'n' || n_nationkey AS stem, r_name AS run, CAST(n_nationkey * 7 AS BIGINT) AS input_tokens, n_nationkey / 4 AS elapsed_s FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_sidecars(t: Tables) -> DataFrame:
    rows = places(t).select(S("r_name").alias("run"), F.concat(F.lit("n"), "n_nationkey").alias("name"), (S("n_nationkey") * 7).alias("input_tokens"), (S("n_nationkey") / 4).alias("elapsed_s"))
    return readers.read_sidecars(t.spark, put(t, rows, "run", "name", ".meta.json")).select("stem", "run", "input_tokens", "elapsed_s")


@query("""WITH s AS (SELECT n_regionkey AS r, sum(CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END) AS e FROM nation GROUP BY 1)
SELECT r_name AS suite_id, 'm' || r_regionkey AS model, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 100 + r_regionkey ELSE e END AS DOUBLE) AS suite_elapsed_s, n_name AS stem, CAST(n_nationkey % 3 AS BIGINT) AS rc FROM nation JOIN region ON n_regionkey = r_regionkey JOIN s ON r = r_regionkey""")
def read_suites(t: Tables) -> DataFrame:
    image = F.struct(S("n_name").alias("stem"), (S("n_nationkey") % 3).alias("rc"), F.when(S("n_nationkey") % 4 > 0, S("n_nationkey").cast("double")).alias("elapsed_s"))
    even = S("r_regionkey") % 2 == 0
    name = F.concat(F.lit("m"), "r_regionkey")
    rows = places(t).groupBy("r_regionkey", S("r_name").alias("suite_id")).agg(F.collect_list(image).alias("per_image"))
    rows = rows.select(F.lit("suites").alias("run"), S("suite_id").alias("name"), "suite_id", F.when(even, name).alias("model"), F.when(~even, name).alias("vision_model"), F.when(even, 100.0 + S("r_regionkey")).alias("elapsed_total_s"), "per_image")
    return readers.read_suites(t.spark, put(t, rows, "run", "name")).select("suite_id", "model", "suite_elapsed_s", "stem", *big("rc"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size % 2 = 0 THEN p_name || ' é°' ELSE p_name END AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def read_gold_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "gold")
    rows = t.part.select(S("p_partkey").alias("key"), F.when(S("p_size") % 2 == 0, F.concat("p_name", F.lit(" é°"))).otherwise(S("p_name")).alias("name"), S("p_size").alias("size"))
    rows.write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return readers.read_gold_csv(t.spark, path).select("key", "name", "size")


@query("SELECT n_name AS file_name, c_custkey || '_1' AS reaction_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_gold_json(t: Tables) -> DataFrame:
    """Arrays of records, a file for each nation; one with a single customer is an array too."""
    path = scratch_path(t.spark, "gold")
    rows = t.customer.join(t.nation, S("c_nationkey") == S("n_nationkey")).select("n_nationkey", F.struct(S("n_name").alias("file_name"), F.array(F.struct(F.concat(S("c_custkey").cast("string"), F.lit("_1")).alias("reaction_id"))).alias("reactions")).alias("r"))
    rows.groupBy("n_nationkey").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return readers.read_gold_json(t.spark, path, schemas.RECORD).select("file_name", F.explode("reactions").alias("r")).select("file_name", "r.reaction_id")


@query("""SELECT 'f' || event_id AS stem, event_type <> 'error' AS ok, round(value, 1) AS elapsed_s, CAST(event_id % 7 AS BIGINT) AS tool_calls, user_id AS input_tokens, event_id AS output_tokens FROM events WHERE event_id % 3 > 0""")
def parse_run_log(t: Tables) -> DataFrame:
    e = t.events
    line = F.format_string("[%d/%d] %s  f%d.png (%.1fs, %d tools, in=%d, out=%d)", "event_id", F.lit(9), F.when(S("event_type") == "error", "FAILED").otherwise("OK"), "event_id", F.round("value", 1), S("event_id") % 7, "user_id", "event_id")
    other = F.concat(F.lit("loading "), "event_type")
    return readers.parse_run_log(e.select(F.when(S("event_id") % 3 > 0, line).otherwise(other).alias("value"))).select("stem", "ok", "elapsed_s", *big("tool_calls"), "input_tokens", "output_tokens")


@query("""SELECT conv_id AS file, CAST(turn + 1 AS BIGINT) AS message, role AS agent, trim(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS text FROM conversations""")
def parse_conversation(t: Tables) -> DataFrame:
    """Turns as transcript lines behind a head for each, and read again; white space at the ends of a message doesn't count."""
    c = t.conversations
    lines = F.concat(F.array(F.format_string("---------- TextMessage (%s) ----------", "role")), F.split("text", "\n"))
    rows = c.select(S("conv_id").alias("file"), (S("turn") + 1).alias("turn"), F.posexplode(lines).alias("k", "value")).select("file", (S("turn") * 1_000_000 + S("k")).alias("line_no"), "value")
    first = c.select(S("conv_id").alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit("starting").alias("value")).distinct()
    out = readers.parse_conversation(rows.union(first))
    return out.select("file", "message", "agent", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("text"))


@query("""SELECT CAST(turn + 1 AS BIGINT) AS message, role || '_' || conv_id AS agent, trim(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS text FROM conversations""")
def read_transcripts(t: Tables) -> DataFrame:
    """A transcript file for each conversation, through the registered source; heads name the role and the conversation."""
    path = scratch_path(t.spark, "transcripts")
    lines = F.concat(F.array(F.format_string("---------- TextMessage (%s_%d) ----------", "role", "conv_id")), F.split("text", "\n"))
    rows = t.conversations.select("conv_id", "turn", F.posexplode(lines).alias("k", "value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "k")
    rows.select("conv_id", "value").write.partitionBy("conv_id").text(path)
    logfiles.register(t.spark)
    return t.spark.read.format("transcripts").load(path).select(*big("message"), "agent", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("text"))


@query("""SELECT 'f' || event_id AS stem, event_type <> 'error' AS ok, round(value, 1) AS elapsed_s, CAST(event_id % 7 AS BIGINT) AS tool_calls, user_id AS input_tokens, event_id AS output_tokens FROM events""")
def stream_run_logs(t: Tables) -> DataFrame:
    """Events as lines of eight run logs, streamed two files a batch through the registered source."""
    path = scratch_path(t.spark, "logs")
    line = F.format_string("[%d/%d] %s  f%d.png (%.1fs, %d tools, in=%d, out=%d)", "event_id", F.lit(9), F.when(S("event_type") == "error", "FAILED").otherwise("OK"), "event_id", F.round("value", 1), S("event_id") % 7, "user_id", "event_id")
    t.events.select(line.alias("value")).repartition(8).write.text(f"{path}/in")
    logfiles.register(t.spark)
    stream = t.spark.readStream.format("runlogs").option("suffix", ".txt").option("maxFilesPerTrigger", 2).load(f"{path}/in")
    return streams.to_table(stream, f"{path}/out", f"{path}/checkpoint").select("stem", "ok", "elapsed_s", *big("tool_calls"), "input_tokens", "output_tokens")


@query("""SELECT p_partkey AS key, 'C.N' AS "REACTANTS", p_brand AS "PRODUCTS", p_brand AS product, CASE WHEN p_size % 2 = 0 THEN 'C.N' ELSE 'C' END AS reactant, CASE WHEN p_size % 3 = 0 THEN 'O.CO' ELSE '' END AS "SOLVENT", CASE WHEN p_size % 3 = 1 THEN 'Pd' ELSE '' END AS "CATALYST" FROM part""")
def read_reaction_xml(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "xml")
    one = lambda tag, s, role="": f'<{tag}{role}><identifier dictRef="cml:smiles">{s}</identifier><identifier dictRef="cml:inchi">x</identifier></{tag}>'
    k = S("p_size")
    agents = F.when(k % 3 == 0, one("spectator", "O", ' role="solvent"') + one("spectator", "CO", ' role="solvent"')).when(k % 3 == 1, one("spectator", "Pd", ' role="catalyst"')).otherwise("")
    doc = F.concat(
        F.lit("<reaction><source><documentId>"), S("p_partkey").cast("string"), F.lit("</documentId></source><reactionSmiles>C.N&gt;O&gt;"), "p_brand", F.lit('</reactionSmiles><productList><product><identifier dictRef="cml:smiles">'), "p_brand", F.lit("</identifier></product></productList><reactantList>"),
        F.when(k % 2 == 0, one("reactant", "C") + one("reactant", "N")).otherwise(one("reactant", "C")), F.lit("</reactantList><spectatorList>"), agents, F.lit("</spectatorList></reaction>"),
    )
    lists = t.part.groupBy(S("p_brand").alias("file")).agg(F.concat(F.lit("<reactionList>"), F.array_join(F.collect_list(doc), ""), F.lit("</reactionList>")).alias("value"))
    lists.write.partitionBy("file").text(path)  # a document for each brand
    got = readers.read_reaction_xml(t.spark, path)
    return got.select(S("REF").cast("long").alias("key"), "REACTANTS", "PRODUCTS", "product", "reactant", "SOLVENT", "CATALYST")


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, l_suppkey AS s FROM lineitem), r AS (SELECT k, coalesce(string_agg(DISTINCT CAST(s AS VARCHAR), '.' ORDER BY CAST(s AS VARCHAR)) FILTER (f = 'R'), '') AS solvents, max(s) FILTER (f = 'A') AS y FROM l GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS reaction_id, o_orderstatus || '>>' || o_orderpriority AS "REACTION", solvents AS "SOLVENT", CAST(coalesce(y, 7) AS DOUBLE) AS "YIELD", CAST(o_custkey % 5 AS DOUBLE) AS time, o_orderpriority AS procedure FROM orders JOIN r ON k = o_orderkey""")
def flatten_ord(t: Tables) -> DataFrame:
    """Orders as open-reaction documents: a flag of R makes a line's supplier a solvent, one of A a stated yield."""
    ident = lambda c: F.array(F.struct(F.lit("NAME").alias("type"), F.lit("x").alias("value")), F.struct(F.lit("SMILES").alias("type"), c.alias("value")))
    part = lambda c, role: F.struct(F.array(F.struct(ident(c).alias("identifiers"), F.lit(role).alias("reaction_role"))).alias("components"))
    lines = t.lineitem.groupBy(S("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(S("l_returnflag") == "R", S("l_suppkey").cast("string"))).alias("solvents"), F.collect_list(F.when(S("l_returnflag") == "A", S("l_suppkey").cast("double"))).alias("yields"))
    o = t.orders.join(lines, "o_orderkey")
    solvents = F.struct(F.transform("solvents", lambda s: F.struct(ident(s).alias("identifiers"), F.lit("SOLVENT").alias("reaction_role"))).alias("components"))
    measured = F.transform("yields", lambda y: F.struct(F.lit("YIELD").alias("type"), F.struct(F.lit(1.0).alias("value")).alias("percentage"), F.struct(y.alias("value")).alias("float_value")))
    lone = F.array(F.struct(F.lit("YIELD").alias("type"), F.struct(F.lit(7.0).alias("value")).alias("percentage"), F.lit(None).cast("struct<value: double>").alias("float_value")))
    product = lambda smiles, desired, m: F.struct(ident(smiles).alias("identifiers"), F.lit(desired).alias("is_desired_product"), m.alias("measurements"))
    none = F.array().cast("array<struct<type: string, percentage: struct<value: double>, float_value: struct<value: double>>>")
    outcomes = F.array(F.struct(F.struct((S("o_custkey") % 5).cast("double").alias("value"), F.lit("HOUR").alias("units")).alias("reaction_time"), F.array(product(S("o_orderpriority"), True, F.when(F.size("yields") > 0, measured).otherwise(none)), product(nothing(), False, lone)).alias("products")))
    doc = o.select(S("o_orderkey").cast("string").alias("reaction_id"), F.create_map(F.lit("a"), part(S("o_orderstatus"), "REACTANT"), F.lit("b"), solvents).alias("inputs"), outcomes.alias("outcomes"), F.struct(S("o_orderpriority").alias("procedure_details")).alias("notes"), F.struct(F.lit("d").alias("doi")).alias("provenance"))
    path = scratch_path(t.spark, "ord")
    doc.write.json(path)
    return readers.flatten_ord(t.spark.read.schema(readers.ORD).json(path)).select("reaction_id", "REACTION", "SOLVENT", "YIELD", "time", "procedure")


@query("SELECT p_type AS class, p_name AS name, row_number() OVER (ORDER BY p_type, p_name, p_partkey) AS pos FROM part")
def pattern_db(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "patterns")
    writers.write_patterns(t.part.select(S("p_type").alias("class"), S("p_name").alias("name"), F.lit("C>>N").alias("smirks"), "p_partkey"), path, ["class", "name", "p_partkey"])
    return readers.read_patterns(t.spark, path).select("class", "name", "pos")


@query("SELECT 'n' || n_nationkey AS stem, '.json' AS suffix FROM nation")
def list_corpus(t: Tables) -> DataFrame:
    path = put(t, places(t).select(S("r_name").alias("run"), F.concat(F.lit("n"), "n_nationkey").alias("name"), "n_name"), "run", "name")
    return readers.list_corpus(t.spark, path, "json").where("length > 0").select("stem", "suffix")


@query("SELECT r_name AS run, count(*) AS files, CASE WHEN r_regionkey % 2 = 0 THEN 'kept' END AS folder FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def list_runs(t: Tables) -> DataFrame:
    path = put(t, places(t).select(S("r_name").alias("run"), F.concat(F.lit("n"), "n_nationkey").alias("name"), "n_name"), "run", "name")
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", S("modificationTime").alias("modified"))
    return readers.list_runs(files, t.region.where("r_regionkey % 2 = 0").select(S("r_name").alias("run"), F.lit("kept").alias("folder"))).select("run", "files", "folder")


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS series, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL")
def read_trend(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "trend")
    t.orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderpriority").agg(F.count(F.lit(1))).write.csv(path, header=True, sep=";")
    return readers.read_trend(t.spark, path, sep=";").where("value IS NOT NULL").select(*big("year"), "series", "value")


@query("SELECT p_brand AS brand, min(p_name) AS name FROM part GROUP BY 1")
def read_dimension(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dimension")
    t.part.select(S("p_brand").alias("brand"), S("p_name").alias("name")).write.csv(path, header=True)
    return readers.read_dimension(t.spark, path, "brand")


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'H225,H319' ELSE 'H319' END AS codes, CASE WHEN s_suppkey % 2 = 0 THEN 'Eye irritation|Flammable liquid' ELSE 'Eye irritation' END AS statements, CASE WHEN s_suppkey % 3 = 0 THEN 'Danger' END AS signal FROM supplier""")
def read_ghs(t: Tables) -> DataFrame:
    info = lambda ref, name, *lines: F.struct(F.lit(ref).alias("ReferenceNumber"), F.lit(name).alias("Name"), F.struct(F.array(*[F.struct(F.lit(x).alias("String")) for x in lines]).alias("StringWithMarkup")).alias("Value"))
    eye, fire = "H319 (97%): Eye irritation", "H225: Flammable liquid"
    own = F.when(S("s_suppkey") % 2 == 0, F.array(info(4, "GHS Hazard Statements", eye, fire))).otherwise(F.array(info(4, "GHS Hazard Statements", eye)))
    signal = F.when(S("s_suppkey") % 3 == 0, F.array(info(4, "Signal", "Danger"))).otherwise(F.array(info(9, "Signal", "Danger")))
    section = lambda heading, inner, field: F.array(F.struct(F.lit(heading).alias("TOCHeading"), inner.alias(field)))
    tree = section("Safety and Hazards", section("Hazards Identification", section("GHS Classification", F.concat(own, signal, F.array(info(9, "GHS Hazard Statements", "H300: Fatal"))), "Information"), "Section"), "Section")
    refs = F.array(F.struct(F.lit(9).alias("ReferenceNumber"), F.lit("Other").alias("SourceName")), F.struct(F.lit(4).alias("ReferenceNumber"), F.lit("European Chemicals Agency (ECHA)").alias("SourceName")))
    docs = t.supplier.select(F.to_json(F.struct(F.struct(S("s_name").alias("RecordTitle"), tree.alias("Section"), refs.alias("Reference")).alias("Record"))).alias("document"))
    return readers.read_ghs(docs).select("name", F.array_join("codes", ",").alias("codes"), F.array_join("statements", "|").alias("statements"), "signal")


# --- sinks and incremental work


def small_db(t: Tables) -> DataFrame:
    return t.part.select(S("p_partkey").alias("REACTION"), S("p_name").alias("NAME"), S("p_retailprice").alias("YIELD"), F.array("p_brand", "p_type").alias("FG"))


@query('SELECT p_partkey AS "REACTION", p_name AS "NAME", p_retailprice AS "YIELD" FROM part')
def db_parquet(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "db")
    writers.write_db(small_db(t), path)
    return readers.read_db(t.spark, path).select("REACTION", "NAME", "YIELD")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "REACTION", p_name AS "NAME", p_retailprice AS "YIELD", p_brand || '|' || p_type AS "FG" FROM part""")
def db_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "db")
    writers.write_csv(small_db(t), path)
    return readers.read_db_csv(t.spark, path)


@query("SELECT 'regions' AS sheet, r_name AS name FROM region UNION ALL SELECT 'nations', n_name FROM nation")
def sheets(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "book")
    writers.write_sheets({"regions": t.region, "nations": t.nation}, path)
    one = lambda sheet, c: t.spark.read.csv(f"{path}/{sheet}", header=True).select(F.lit(sheet).alias("sheet"), S(c).alias("name"))
    return one("regions", "r_name").union(one("nations", "n_name"))


@query('SELECT CAST(p_partkey AS VARCHAR) AS "ENTRY_ID", p_name AS "NAME", 32 AS columns FROM part')
def enriched_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "enriched")
    writers.write_enriched_csv(t.part.select(S("p_partkey").alias("ENTRY_ID"), S("p_name").alias("NAME"), S("p_size").alias("other")), path)
    got = t.spark.read.csv(path, header=True)
    return got.select("ENTRY_ID", "NAME", F.lit(len(got.columns)).alias("columns"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def report(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    counts = t.orders.groupBy(S("o_orderpriority").alias("priority"), S("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    writers.write_report(counts, path, ["priority"])
    return t.spark.read.json(path).select("priority", F.explode("rows").alias("r")).select("priority", "r.status", "r.n")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def merge_chunks(t: Tables) -> DataFrame:
    a = t.part.where("p_partkey % 2 = 0").select(S("p_partkey").alias("key"), S("p_name").alias("name"))
    b = t.part.where("p_partkey % 2 = 1").select(S("p_partkey").cast("string").alias("key"), S("p_size").cast("long").alias("size"))
    return writers.merge_chunks([a, b]).select("key", "name", "size")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(S("l_orderkey").alias("o_orderkey"))
    return writers.pending(t.orders, done, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS mark FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0")
def replace_partition(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "partitions")
    rows = t.orders.select("o_orderkey", S("o_orderstatus").alias("status"))
    writers.replace_partition(rows.withColumn("mark", F.lit("old")), path, "status")
    for _ in range(2):  # again changes nothing
        writers.replace_partition(rows.where("status = 'P' AND o_orderkey % 2 = 0").withColumn("mark", F.lit("new")), path, "status")
    return t.spark.read.parquet(path).select("o_orderkey", "status", "mark")


# --- extractions and records


def extracted(t: Tables) -> DataFrame:
    """Orders as extractions of one reaction: flags of lines are reactants, states reagents; those of odd orders have two products."""
    one = lambda **f: F.struct(*[f.get(c, nothing()).alias(c) for c in ("label", "name", "smiles", "role_note", "equiv")])
    reagent = lambda **f: F.struct(*[f.get(c, nothing()).alias(c) for c in ("label", "name", "smiles", "role_note", "loading", "role")])
    product = lambda label, y: F.struct(label.alias("label"), F.lit("p").alias("name"), F.lit("CO").alias("smiles"), nothing().alias("role_note"), y.cast("double").alias("yield_pct"), nothing().alias("yield_note"))
    k = S("o_orderkey")
    reactants = F.array(one(label=S("o_orderstatus"), smiles=F.when(k % 3 == 0, "C"), equiv=F.when(k % 2 == 0, "2 eq")), one(name=F.lit("acid"), smiles=F.lit("")))
    reagents = F.array(reagent(name=S("o_orderpriority"), loading=F.lit("5%"), role=F.when(k % 4 == 0, "Catalyst").otherwise("base")))
    conditions = F.struct(*[c.alias(n) for n, c in {"temperature": F.when(k % 5 == 0, "rt").otherwise(""), "time": F.lit("2 h"), "atmosphere": nothing(), "solvent": F.lit("water"), "other": F.when(k % 7 == 0, "dark")}.items()])
    none = F.array().cast("array<struct<label: string, name: string, smiles: string, role_note: string, yield_pct: double, yield_note: string>>")
    products = F.when(k % 3 == 1, none).otherwise(F.array(product(F.lit("2a"), F.when(k % 2 == 0, k % 100)), product(F.lit("2b"), (k % 100) + 0.5)))
    reaction = F.struct(S("o_orderkey").cast("string").alias("entry_id"), F.when(k % 2 == 0, "t").alias("title"), F.lit("").alias("notes"), reactants.alias("reactants"), reagents.alias("reagents"), conditions.alias("conditions"), products.alias("products"))
    return t.orders.select(F.concat(F.lit("f"), k).alias("stem"), S("o_orderpriority").alias("figure_caption"), F.array(reaction).alias("reactions"))


EXTRACTED = "WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),"


FLAT_SQL = EXTRACTED + """x AS (SELECT k, s, p, CASE WHEN k % 3 = 1 THEN NULL ELSE unnest(['2a', '2b']) END AS label FROM o), y AS (SELECT DISTINCT k, s, p, label FROM x)
SELECT 'f' || k AS source_image, CAST(k AS VARCHAR) AS entry_id, CASE WHEN k % 2 = 0 THEN 't' ELSE '' END AS reaction_title, s || CASE WHEN k % 2 = 0 THEN ' (2 eq)' ELSE '' END || CASE WHEN k % 3 = 0 THEN ': C' ELSE '' END || '; acid' AS reactants,
p || ' (5%, ' || CASE WHEN k % 4 = 0 THEN 'Catalyst' ELSE 'base' END || ')' AS reagents, 'water' AS solvent, coalesce(label, '') AS product_label, CASE WHEN label IS NULL THEN '' ELSE 'CO' END AS product_smiles,
CASE WHEN label = '2a' AND k % 2 = 0 THEN CAST(k % 100 AS DOUBLE) WHEN label = '2b' THEN k % 100 + 0.5 END AS yield_pct FROM y"""


@query(FLAT_SQL)
def flatten_products(t: Tables) -> DataFrame:
    return reshape.flatten_products(extracted(t)).select("source_image", "entry_id", "reaction_title", "reactants", "reagents", "solvent", "product_label", "product_smiles", "yield_pct")


@query(f"WITH f AS ({FLAT_SQL}) SELECT source_image, nullif(entry_id, '') AS entry_id, nullif(reactants, '') AS reactants, nullif(product_label, '') AS product_label, nullif(product_smiles, '') AS product_smiles, yield_pct, '{','.join(schemas.FLAT_COLUMNS)}' AS header FROM f")
def flat_csv(t: Tables) -> DataFrame:
    """The flat product table, written as CSV and read back, with its header; empty cells are null."""
    path = scratch_path(t.spark, "flat")
    writers.write_flat_csv(reshape.flatten_products(extracted(t)), path)
    got = t.spark.read.csv(path, header=True, escape='"')
    return got.select("source_image", "entry_id", "reactants", "product_label", "product_smiles", S("yield_pct").cast("double").alias("yield_pct"), F.lit(",".join(got.columns)).alias("header"))


@query(EXTRACTED + """y AS (SELECT k, s, p, CASE WHEN label = '2a' THEN CASE WHEN k % 2 = 0 THEN CAST(k % 100 AS VARCHAR) END ELSE k % 100 || '.5' END AS v, label FROM (SELECT *, unnest(['2a', '2b']) AS label FROM o) WHERE k % 3 <> 1),
z AS (SELECT k, string_agg('; yield: ' || v || ' %', '' ORDER BY label) AS y FROM y WHERE v IS NOT NULL GROUP BY 1)
SELECT 'f' || k AS stem, '0_1' AS reaction_id, s || '=' || CASE WHEN k % 3 = 0 THEN 'C' ELSE '' END || ',=' AS reactants, CASE WHEN k % 4 = 0 THEN 'catalyst' ELSE 'reagent' END || ': ' || p || CASE WHEN k % 5 = 0 THEN '; temperature: rt' ELSE '' END || '; time: 2 h; solvent: water' || CASE WHEN k % 7 = 0 THEN '; reagent: dark' ELSE '' END || coalesce(y, '') AS conditions,
'entry: ' || k || CASE WHEN k % 2 = 0 THEN '|title: t' ELSE '' END AS info FROM o LEFT JOIN z USING (k)""")
def to_record(t: Tables) -> DataFrame:
    r = reshape.to_record(extracted(t)).select("stem", F.explode("reactions").alias("r"))
    shown = F.array_join(F.transform("r.reactants", lambda m: F.concat(F.coalesce(m["label"], F.lit("")), F.lit("="), F.coalesce(m["smiles"], F.lit("")))), ",")
    return r.select("stem", "r.reaction_id", shown.alias("reactants"), F.array_join(F.transform("r.conditions", lambda c: F.concat_ws(": ", c["role"], c["text"])), "; ").alias("conditions"), F.array_join("r.additional_info", "|").alias("info"))


@query("""SELECT conv_id, turn, CASE WHEN role IN ('reagent', 'solvent', 'catalyst', 'time') THEN role ELSE 'reagent' END AS plain, CASE WHEN turn % 3 = 0 THEN 'solvent' ELSE 'reagent' END AS coerced, CASE turn % 4 WHEN 0 THEN 'solvent' WHEN 1 THEN 'ee' WHEN 2 THEN 'dr' END AS suffix FROM conversations""")
def roles(t: Tables) -> DataFrame:
    k = S("turn")
    words = F.when(k % 4 == 1, "91% EE ").when(k % 4 == 2, "14:1 dr").when(k % 4 == 0, "91% ee").otherwise("")
    given = F.when(k % 4 == 0, " Solvents ").otherwise("")
    return t.conversations.select("conv_id", "turn", reshape.coerce_role("role").alias("plain"), reshape.coerce_role(F.when(k % 3 == 0, "SOLVENT").when(k % 3 == 1, "oxidant")).alias("coerced"), text.suffix_role(given, words).alias("suffix"))


def loose(t: Tables) -> DataFrame:
    """Customers' orders as reactions of a record in which much is missing or marked as missing."""
    k = S("o_orderkey")
    smiles = F.when(k % 5 == 0, "None").when(k % 5 == 1, " ").when(k % 5 == 2, "<invalid>").otherwise(S("o_orderstatus"))
    reactants = F.array(species(smiles, F.when(k % 2 == 0, F.lit("1a"))), species(S("o_orderstatus")))
    conditions = F.when(k % 6 > 0, F.array(condition(F.when(k % 2 == 0, "Solvents").otherwise("oxidant"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))), condition(F.lit(""), F.lit("80% ee")), condition(F.lit("time"), F.lit(" "))))
    one = F.struct(F.concat(k.cast("string"), F.lit("_1")).alias("reaction_id"), reactants.alias("reactants"), F.array(species(F.lit("CO"))).alias("products"), conditions.alias("conditions"), F.array(F.lit("x"), nothing()).alias("additional_info"))
    return t.orders.groupBy(S("o_custkey").alias("stem")).agg(F.collect_list(one).alias("reactions"))


@query("""SELECT o_custkey AS stem, o_orderkey || '_1' AS reaction_id, CASE WHEN o_orderkey % 5 > 2 THEN o_orderstatus || ',' WHEN o_orderkey % 2 = 0 THEN '1a,' ELSE '' END || o_orderstatus AS reactants,
CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'solvent' ELSE 'reagent' END || '=' || o_orderpriority || ';ee=80% ee' END AS conditions, 'x' AS info FROM orders""")
def normalise_record(t: Tables) -> DataFrame:
    r = reshape.normalise_record(loose(t)).select("stem", F.explode("reactions").alias("r"))
    shown = F.array_join(F.transform("r.reactants", lambda m: F.coalesce(m["smiles"], m["label"])), ",")
    return r.select("stem", "r.reaction_id", shown.alias("reactants"), F.array_join(F.transform("r.conditions", lambda c: F.concat_ws("=", c["role"], c["text"])), ";").alias("conditions"), F.array_join("r.additional_info", ",").alias("info"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '|plain' WHEN event_id % 3 = 1 THEN event_type END AS info FROM events""")
def info_text(t: Tables) -> DataFrame:
    doc = F.when(S("event_id") % 3 == 0, F.format_string('[{"text": "%s"}, "plain", {"other": 1}]', "event_type")).when(S("event_id") % 3 == 1, F.format_string('["%s"]', "event_type")).otherwise("not json")
    return t.events.select("event_id", doc.alias("doc")).select("event_id", F.array_join(reshape.info_text("doc"), "|").alias("info"))


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS n, s_name FROM supplier) SELECT n AS file_name, (row_number() OVER (PARTITION BY n ORDER BY s_name) - 1) || '_1' AS reaction_id, s_name AS variant, s_name AS product FROM s""")
def explode_variants(t: Tables) -> DataFrame:
    value = F.struct(F.array(F.lit("C")).alias("reactants"), F.array("s_name").alias("products"))
    rows = t.supplier.groupBy(S("s_nationkey").alias("file_name")).agg(F.map_from_entries(F.collect_set(F.struct("s_name", value))).alias("detailed_reactions"))
    return reshape.explode_variants(rows).select("file_name", "reaction_id", "variant", S("products")[0].alias("product"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey AS file_name, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey ELSE i || '_1' END AS reaction_id, CASE WHEN o_orderkey % 3 = 0 THEN 'CO' ELSE 'C,CO' END AS reactants,
'catalyst=Pd' || CASE WHEN o_orderkey % 4 = 0 THEN ';yield=' || (o_orderkey % 100) || '%' WHEN o_orderkey % 4 = 1 THEN ';yield=13%' ELSE ';yield=trace' END || ';dr=' || o_orderstatus AS conditions FROM o""")
def rows_to_records(t: Tables) -> DataFrame:
    k = S("o_orderkey")
    rows = t.orders.select(S("o_custkey").alias("file_name"), k.alias("row_no"), F.when(k % 2 == 0, F.concat(F.lit("r"), k)).otherwise("").alias("reaction_id"), F.lit("None").alias("label"), F.when(k % 3 == 0, "").otherwise("C").alias("rec_1"), F.lit("CO").alias("rec_2"), F.lit("CN").alias("pro_1"), F.lit("<invalid>").alias("pro_2"), F.lit("").alias("cat_1"), nothing().alias("cat_2"), F.lit("Pd").alias("catalyst_text"), F.lit("").alias("solvent"), F.lit(" ").alias("temperature"), F.when(k % 4 == 0, (k % 100).cast("string")).when(k % 4 == 1, "0.13").otherwise("trace").alias("yield"), F.lit("").alias("ee"), S("o_orderstatus").alias("dr"), nothing().alias("er"))
    r = reshape.rows_to_records(rows).select("file_name", F.explode("reactions").alias("r"))
    return r.select("file_name", "r.reaction_id", F.array_join(F.transform("r.reactants", lambda m: m["smiles"]), ",").alias("reactants"), F.array_join(F.transform("r.conditions", lambda c: F.concat_ws("=", c["role"], c["text"])), ";").alias("conditions"))


@query(r"""SELECT event_id, CASE WHEN round(value, 2) > 0 AND round(value, 2) <= 1 THEN CAST(CAST(round(round(value, 2) * 100) AS BIGINT) AS VARCHAR) || '%' ELSE regexp_replace(CAST(round(value, 2) AS VARCHAR), '\.0$', '') || '%' END AS percent,
'yield=' || (event_id % 90 + 1) || '% yield;yield=91%;ee=91% ee;dr=3:1 dr;reagent=ee' AS parts, CASE event_type WHEN 'view' THEN 'time' WHEN 'click' THEN 'temperature' WHEN 'signup' THEN 'yield' WHEN 'error' THEN 'atmosphere' ELSE 'reagent' END AS role FROM events""")
def condition_texts(t: Tables) -> DataFrame:
    words = F.concat((S("event_id") % 90 + 1).cast("string"), F.lit("% yield, 91% ee, 3:1 dr"))
    told = F.when(S("event_type") == "view", "stirred 3 h ").when(S("event_type") == "click", "at 80 °C").when(S("event_type") == "signup", "81% isolated").when(S("event_type") == "error", "under N2").otherwise("NaH")
    shown = F.array_join(F.transform(text.split_conditions(words), lambda c: F.concat_ws("=", c["role"], c["text"])), ";")
    return t.events.select("event_id", text.percent_text(F.round("value", 2).cast("string")).alias("percent"), shown.alias("parts"), text.condition_role(told).alias("role"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS name, CASE WHEN o_orderpriority = '5-LOW' THEN '5-LOW' END AS was FROM orders")
def fix_names(t: Tables) -> DataFrame:
    repairs = t.region.where("r_regionkey = 0").select(F.lit("5-LOW").alias("wrong"), F.lit("LOW").alias("right"))
    fixed, done = reshape.fix_names(t.orders.select("o_orderkey", S("o_orderpriority").alias("file_name")), repairs)
    return fixed.join(done.distinct(), S("file_name") == S("right"), "left").select("o_orderkey", S("file_name").alias("name"), S("wrong").alias("was"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 4 AS m, p_brand AS b FROM part) SELECT k AS figure, 'reaction' AS kind, 'C.' || b || '>>CO' AS value FROM p WHERE m = 0 UNION ALL SELECT k, 'molecule', 'CO' FROM p WHERE m = 2""")
def reaction_rows(t: Tables) -> DataFrame:
    """Reactions whole, with a wildcard, without reactants, and with an empty structure."""
    m = S("p_size") % 4
    rows = t.part.select(S("p_partkey").alias("figure"), F.lit(0).alias("idx"), F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("C"), F.when(m == 1, "[R1]").when(m == 3, nothing()).otherwise(S("p_brand")))).alias("reactants"), F.array(F.lit("CO")).alias("products"))
    whole, lone = reshape.reaction_rows(rows, "figure")
    return whole.select("figure", F.lit("reaction").alias("kind"), S("reaction").alias("value")).union(lone.select("figure", F.lit("molecule"), "molecule"))


@query("""WITH o AS (SELECT o_custkey AS f, o_orderkey AS k, o_orderstatus = 'P' AS w, o_orderpriority = '1-URGENT' AS gold FROM orders), g AS (SELECT f, bool_or(w) AS generic FROM o WHERE gold GROUP BY 1)
SELECT k AS idx FROM o LEFT JOIN g USING (f) WHERE NOT gold AND (coalesce(generic, false) OR NOT w)""")
def wildcard_policy(t: Tables) -> DataFrame:
    rows = t.orders.select(S("o_custkey").alias("f"), S("o_orderkey").alias("idx"), "o_orderpriority", F.array(F.when(S("o_orderstatus") == "P", "C*").otherwise("C"), nothing()).alias("reactants"), F.array(F.lit("CO")).alias("products"))
    urgent = S("o_orderpriority") == "1-URGENT"
    return reshape.wildcard_policy(rows.where(~urgent), rows.where(urgent), ["f"]).select("idx")


@query("""SELECT p_name AS "SOLVENT", 'not-reported' AS "REAGENT", 'not-reported' AS "CATALYST", p_partkey AS "REF", CAST(NULL AS DOUBLE) AS "YIELD" FROM part""")
def standardise_db(t: Tables) -> DataFrame:
    return reshape.standardise_db(t.part.select("p_name", "p_partkey"), SOLVENT="p_name", REF="p_partkey").select("SOLVENT", "REAGENT", "CATALYST", "REF", "YIELD")


@query("SELECT p_partkey, CAST(p_size % 3 AS BIGINT) AS reactants, CAST(p_size % 2 + 1 AS BIGINT) AS products, 'N' AS agents FROM part")
def pattern_arity(t: Tables) -> DataFrame:
    left = F.array_join(F.array_repeat(F.lit("C"), S("p_size") % 3), ".")
    pattern = F.concat(left, F.lit(">N>"), F.when(S("p_size") % 2 == 0, "O").otherwise("O.CO"))
    return t.part.select("p_partkey", molecules.pattern_arity(pattern).alias("a"), molecules.sides(pattern)["agents"].alias("g")).select("p_partkey", S("a.reactants").cast("long").alias("reactants"), S("a.products").cast("long").alias("products"), F.array_join("g", ".").alias("agents"))


@query("""SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'R')) AS BIGINT) AS health, CAST(count(DISTINCT l_returnflag) FILTER (l_returnflag = 'N') AS BIGINT) AS fire FROM lineitem GROUP BY 1""")
def hazard_counts(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("codes"))
    return rows.select("l_orderkey", reshape.hazard_counts("codes", health=("A", "R", "X"), fire=("N",)).alias("h")).select("l_orderkey", S("h.health").cast("long").alias("health"), S("h.fire").cast("long").alias("fire"))


@query("""SELECT o_orderkey AS k, CAST(o_orderkey % 90 AS BIGINT) AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE o_orderstatus || '.C' END AS reactants, 'Pd' AS reagents, o_orderpriority || '; ' AS solvent_hint, '' AS time_hint, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE o_orderstatus || '.C' END || '>Pd>CO' AS full_reaction,
CASE WHEN o_orderkey % 90 < 10 THEN 'found' ELSE '' END AS name FROM orders""")
def classification_rows(t: Tables) -> DataFrame:
    k = S("o_orderkey")
    one = F.struct(F.lit("0_1").alias("reaction_id"), F.array(species(F.when(k % 2 == 0, "None").otherwise(S("o_orderstatus"))), species(F.lit("C"))).alias("reactants"), F.array(species(F.lit("CO"))).alias("products"), F.array(condition(F.lit("solvent"), S("o_orderpriority")), condition(F.lit("solvent"), nothing(), F.lit("Pd"))).alias("conditions"))
    rows = t.orders.select(F.concat(k, F.lit("_page-"), k % 90).alias("stem"), F.array(one).alias("reactions"))
    enriched = t.nation.where("n_nationkey < 10").select(S("n_nationkey").alias("page"), F.lit("0_1").alias("reaction_id"), F.lit("found").alias("name"))
    out = reshape.classification_rows(rows, enriched)
    return out.select(F.regexp_extract("stem", r"^(\d+)", 1).cast("long").alias("k"), S("page").cast("long").alias("page"), "reactants", "reagents", "solvent_hint", "time_hint", "full_reaction", "name")


@query("""SELECT stem, CAST(count(*) AS BIGINT) AS reactions, CAST(sum(CASE WHEN k % 6 > 0 THEN 3 ELSE 0 END) AS BIGINT) AS conditions, CAST(sum(CASE WHEN k % 5 > 2 THEN 3 ELSE 2 END) AS BIGINT) AS structures FROM (SELECT o_custkey AS stem, o_orderkey AS k FROM orders) GROUP BY 1""")
def record_summary(t: Tables) -> DataFrame:
    return rollup.record_summary(loose(t)).select("stem", *big("reactions", "conditions", "structures"))


@query("""SELECT stem, CASE WHEN bad > 0 THEN 'role' ELSE '' END AS errors, bad = 0 AS valid FROM (SELECT o_custkey AS stem, count(*) FILTER (o_orderkey % 6 > 0) AS bad FROM orders GROUP BY 1)""")
def conformance(t: Tables) -> DataFrame:
    """Ids are right and there are no marks of attachment; the roles of ``loose`` are none of the list."""
    return metrics.conformance(loose(t).withColumn("file_name", F.lit("f"))).select("stem", F.array_join("errors", ",").alias("errors"), "valid")


@query("""SELECT o_custkey AS stem, CAST(count(*) * 2 AS BIGINT) AS structures, CAST(count(*) FILTER (o_orderstatus <> 'P') + count(*) AS BIGINT) AS valid, round((count(*) FILTER (o_orderstatus <> 'P') + count(*)) / (count(*) * 2), 6) AS rate FROM orders GROUP BY 1""")
def validity(t: Tables) -> DataFrame:
    rows = t.orders.select(S("o_custkey").alias("stem"), F.array(F.when(S("o_orderstatus") == "P", "C(").otherwise(S("o_orderstatus"))).alias("reactants"), F.array(F.lit("CO"), nothing()).alias("products"), F.array(condition(F.lit("time"), F.lit("2 h"))).alias("conditions"))
    rows = rows.withColumn("reactants", F.transform("reactants", lambda x: F.when(x == "O", "O").when(x == "F", "F").otherwise(x)))
    return rounded(metrics.validity(rows, ["stem"]).select("stem", *big("structures", "valid"), "rate"), "rate")


@query("""SELECT user_id, count(*) AS conditions, count(*) FILTER (event_type = 'error') AS legal, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type <> 'error') AS illegal FROM events GROUP BY 1""")
def role_compliance(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.when(S("event_type") == "error", "solvent").otherwise(S("event_type")).alias("role"))
    return metrics.role_compliance(rows, ["user_id"]).select("user_id", "conditions", "legal", F.array_join("illegal_roles", ",").alias("illegal"))
