"""Canonical log, edge, name and score views over the driver tables.

``Tables`` builds them with DataFrames, ``SQL_VIEWS`` states the same views in SQL
for the oracle. Events stand in for host log records, line items for a large edge
set, parts for file names, embeddings for vectors, documents for log scores.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import times
from traceloom.session import spread

CDM = "com.bbn.tc.schema.avro.cdm18."

SQL_VIEWS: dict[str, tuple[str, str]] = {}  # name -> (views it needs, body)


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        if n in order:
            return
        for d in SQL_VIEWS[n][0].split():
            need(d)
        order.append(n)

    for n in names:
        need(n)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        e = spread(self.read("events"))
        return e.select(
            "event_id", "user_id", "event_type", "value", times.ntz_to_ns(F.col("ts")).alias("ts_ns"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.element_at(F.array(F.lit("audit"), F.lit("dns"), F.lit("firefox")),
                         (F.col("event_id") % 3 + 1).cast("int")).alias("log_type"))

    @cached_property
    def named(self) -> DataFrame:
        """Event rows with CDM ids and event kinds."""
        kind = (F.when(F.col("event_type") == "click", "EVENT_WRITE").when(F.col("event_type") == "view", "EVENT_READ")
                .when(F.col("event_type") == "purchase", "EVENT_SENDTO")
                .when(F.col("event_type") == "signup", "EVENT_EXECUTE")
                .when(F.col("k") % 10 == 0, "EVENT_FLOWS_TO").otherwise("EVENT_OPEN"))
        return self.ev.select(
            "*", F.concat(F.lit("U"), "user_id").alias("subj"),
            F.concat(F.when(F.col("k") % 4 == 0, "N").otherwise("K"), "k").alias("obj"), kind.alias("kind"))

    @cached_property
    def edges(self) -> DataFrame:
        """Typed, timed, directed edges; reads run from the object to the subject."""
        r = F.col("kind") == "EVENT_READ"
        return self.named.filter("kind <> 'EVENT_FLOWS_TO'").select(
            F.col("event_id").alias("log_idx"), "log_type", F.when(r, F.col("obj")).otherwise(F.col("subj")).alias("src"),
            F.when(r, F.col("subj")).otherwise(F.col("obj")).alias("dst"), F.col("kind").alias("action"), "ts_ns", "value",
            times.hour_key(F.col("ts_ns")).alias("window_key"))

    @cached_property
    def edges_big(self) -> DataFrame:
        li = self.read("lineitem")
        return li.select(
            F.col("l_orderkey").alias("log_idx"), F.concat(F.lit("S"), "l_suppkey").alias("src"),
            F.concat(F.lit("P"), "l_partkey").alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("action"),
            times.ntz_to_ns(F.col("l_shipdate")).alias("ts_ns"), F.col("l_linenumber").cast("long").alias("line_no"),
            F.col("l_extendedprice").alias("price"))

    @cached_property
    def cdm_lines(self) -> DataFrame:
        """CDM JSON text lines: one Event per event, one node record per customer, part and supplier."""
        uid = f'{{"{CDM}UUID":"'
        ev = self.named.select(
            F.col("event_id").alias("log_idx"), "log_type", "ts_ns", F.concat(
                F.lit(f'{{"datum":{{"{CDM}Event":{{"uuid":"E'), "event_id", F.lit('","type":"'), "kind",
                F.lit(f'","subject":{uid}'), "subj", F.lit(f'"}},"predicateObject":{uid}'), "obj",
                F.lit('"},"predicateObjectPath":{"string":"/srv/'), "event_type", F.lit("/file"), "k",
                F.lit('.log"},"predicateObject2":'),
                F.when(F.col("k") % 5 == 0, F.concat(F.lit(f'{uid}K'), (F.col("k") + 1).cast("string"), F.lit('"}')))
                .otherwise(F.lit("null")),
                F.lit(',"predicateObject2Path":{"string":"/srv/alt'), "k",
                F.lit('"},"timestampNanos":'), F.col("ts_ns").cast("string"),
                F.lit(',"properties":{"map":{"cmdLine":"run '), "event_type", F.lit('"}}}}}')).alias("line"))
        zero = F.lit(0).cast("long")
        cust = self.read("customer").select(
            (F.col("c_custkey") + 1_000_000_000).alias("log_idx"), F.lit("audit").alias("log_type"), zero.alias("ts_ns"),
            F.concat(F.lit(f'{{"datum":{{"{CDM}Subject":{{"uuid":"U'), "c_custkey", F.lit('","type":"SUBJECT_PROCESS"'),
                     F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(',"cmdLine":{"string":"'), "c_name", F.lit('"}')))
                     .otherwise(F.lit(',"cmdLine":null')),
                     F.lit(',"properties":{"map":{"tgid":"'), F.col("c_nationkey").cast("string"),
                     F.lit('","path":"/bin/'), F.lower("c_mktsegment"), F.lit('"}}}}}')).alias("line"))
        part = self.read("part").select(
            (F.col("p_partkey") + 2_000_000_000).alias("log_idx"), F.lit("audit").alias("log_type"), zero.alias("ts_ns"),
            F.concat(F.lit(f'{{"datum":{{"{CDM}FileObject":{{"uuid":"K'), "p_partkey",
                     F.lit('","type":"FILE_OBJECT_BLOCK"'),
                     F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit(',"filename":"'), "p_name", F.lit('"'))).otherwise(""),
                     F.lit(',"size":'), F.col("p_size").cast("string"), F.lit("}}}")).alias("line"))
        supp = self.read("supplier").select(
            (F.col("s_suppkey") + 3_000_000_000).alias("log_idx"), F.lit("dns").alias("log_type"), zero.alias("ts_ns"),
            F.concat(F.lit(f'{{"datum":{{"{CDM}NetFlowObject":{{"uuid":"N'), "s_suppkey",
                     F.lit('","localAddress":"10.0.0.'), "s_nationkey", F.lit('","localPort":'), "s_suppkey",
                     F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit(',"remoteAddress":"192.168.1.'), "s_nationkey",
                                                                F.lit('","remotePort":"443",'))).otherwise(","),
                     F.lit('"initTcpSeqNum":null}}}')).alias("line"))
        return ev.unionByName(cust).unionByName(part).unionByName(supp)

    @cached_property
    def dirty(self) -> DataFrame:
        """Edges with text faults, so that each cleaning rule has hits."""
        i = F.col("event_id")
        src = (F.when(i % 17 == 0, "").when(i % 19 == 0, F.concat(F.lit("A: "), "subj"))
               .when(i % 23 == 0, F.concat("subj", F.lit("::"))).when(i % 29 == 0, F.lit("4711")).when(i % 31 == 0, "x")
               .when(i % 37 == 0, F.concat(F.lit("uri=http://h"), "user_id", F.lit("/"))).otherwise(F.col("subj")))
        dst = (F.when(i % 13 == 0, F.concat("subj", F.lit(":"))).when(i % 41 == 0, F.concat(F.lit("AAAA: "), "obj"))
               .when(i % 43 == 0, F.concat("subj", F.lit("7"))).when(i % 47 == 0, F.lit("http://h1/"))
               .otherwise(F.col("obj")))
        act = (F.when(i % 11 == 0, "12 34").when(i % 14 == 0, "ok").when(i % 15 == 0, F.concat(F.lit("Read "), "k"))
               .when(i % 21 == 0, ':"Write".').when(i % 22 == 0, "[[Open File]]")
               .when(i % 26 == 0, "Read Data:Write Data").when(i % 27 == 0, "Accesses:\tReadData\tWriteData")
               .when(i % 33 == 0, "https GET").when(i % 34 == 0, F.col("subj")).when(i % 35 == 0, "NO LABEL")
               .when(i % 38 == 0, "First line\nSecond:   third").when(i % 39 == 0, "mode=rw=x")
               .otherwise(F.col("event_type")))
        clock = F.date_format(F.timestamp_seconds(times.seconds(F.col("ts_ns"))), "HH:mm:ss")
        day = F.date_format(F.timestamp_seconds(times.seconds(F.col("ts_ns"))), "yyyy-MM-dd")
        ts = (F.when(i % 16 == 0, "PM").when(i % 18 == 0, "...").when(i % 24 == 0, "12").when(i % 25 == 0, "unknown time")
              .when(i % 28 == 0, F.concat(F.lit("Time :"), clock, F.lit(" PM")))
              .when(i % 32 == 0, F.concat(F.lit("at:"), day, F.lit(" "), clock))
              .when(i % 36 == 0, F.concat(F.lit("click "), clock)).otherwise(F.concat_ws(" ", day, clock)))
        return self.named.select(i.alias("log_idx"), "log_type", src.alias("src"), dst.alias("dst"), act.alias("action"),
                                 ts.alias("ts"), "value", "ts_ns")

    @cached_property
    def names(self) -> DataFrame:
        """File-like names from parts, addresses from suppliers, URLs from pages."""
        p = spread(self.read("part"))
        path = F.concat(F.lit("C:\\\\srv12\\"), F.translate("p_brand", "#", "-"), F.lit("//"),
                        F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string"),
                        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), F.lower("p_type")))
                        .when(F.col("p_partkey") % 3 == 1, F.lit(".v2.log")).otherwise(""))
        s = self.read("supplier")
        addr = F.concat(F.lit("10.0."), "s_nationkey", F.lit("."), (F.col("s_suppkey") % 300).cast("string"),
                        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":"), F.col("s_suppkey").cast("string")))
                        .otherwise(""))
        return (p.select(path.alias("name")).unionAll(s.select(addr.alias("name")))
                .unionAll(self.read("pages").select(F.col("url").alias("name"))))

    @cached_property
    def types(self) -> DataFrame:
        """Type and functionality of two thirds of the objects and all subjects."""
        e = self.edges
        ends = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node"))).distinct()
        n = F.substring("node", 2, 20).cast("long")
        return ends.filter(n % 3 != 0).select(
            "node", F.concat(F.lit("type_"), (n % 5).cast("string")).alias("vtype"),
            F.concat(F.lit("func_"), (n % 7).cast("string")).alias("functionality"))

    @cached_property
    def votes(self) -> DataFrame:
        """Repeated answers: a value per part, and directed edge votes."""
        li = self.read("lineitem")
        return li.select(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("value"),
                         F.concat(F.lit("P"), F.col("l_partkey") % 40).alias("src"),
                         F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("dst"),
                         F.concat("l_returnflag", "l_linestatus").alias("action"),
                         F.when(F.col("l_linestatus") == "O", "->").otherwise("<-").alias("direction"),
                         F.date_format("l_shipdate", "yyyy").alias("ts"),
                         (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))

    @cached_property
    def vecs(self) -> DataFrame:
        e = self.read("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))

    @cached_property
    def scores(self) -> DataFrame:
        """Edge scores: errors are malicious, one attack per user group."""
        return self.ev.select(
            F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "error").cast("long").alias("y"),
            F.concat(F.lit("A"), (F.col("user_id") % 3).cast("string")).alias("attack"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("node"), "log_type", "ts_ns",
            times.day_key(F.col("ts_ns")).alias("day"), times.hour_key(F.col("ts_ns")).alias("window_key"))

    @cached_property
    def log_scores(self) -> DataFrame:
        """Log scores of documents and their labels; unlabelled logs are benign."""
        d, l = self.read("documents"), self.read("labels")
        return d.join(l, "doc_id", "left").select(
            F.col("doc_id").alias("log_idx"), F.col("lang").alias("log_type"),
            F.col("n_chars").cast("double").alias("score"), F.coalesce("toxic", F.lit(0)).cast("long").alias("y"),
            F.col("source").alias("attack"), F.col("quality").isNotNull().alias("scored"))

    @cached_property
    def answers(self) -> DataFrame:
        """Conversation texts with stage, reasoning, quoted-name and verdict lines added by rule."""
        c = self.read("conversations")
        t = F.col("turn")
        stage = F.element_at(F.array(*[F.lit(s) for s in ("Reconnaissance", "initial access", "Execution", "Data Exfiltration",
                                                          "Unknown Step")]), (t % 5 + 1).cast("int"))
        verdict = F.when(F.col("conv_id") % 3 == 0, "Yes").otherwise("no")
        body = F.concat(F.lit("**Stage: "), stage, F.lit("**\n\"U"), (F.col("conv_id") % 150).cast("string"),
                        F.lit('" touched "K'), (t * 7).cast("string"), F.lit('" and "'), "role",
                        F.lit('"\nReasoning: turn '), t.cast("string"), F.lit(" of the chain\n### Final Output\nU"),
                        (F.col("conv_id") % 150).cast("string"), F.lit(" = "), "role",
                        F.lit("\n(U1, K2) A: [...]\nFilename: a"), t.cast("string"), F.lit(" | Classification: "),
                        F.when(t % 3 == 0, "INVALID").when(t % 3 == 1, "valid").otherwise("Command-Line"),
                        F.lit(" | Type: tool\n<think>draft</think>"), verdict, F.lit(" because YES\n"))
        return c.select("conv_id", t.cast("long").alias("turn"), "role", F.concat(body, F.col("text")).alias("text"))


SQL_VIEWS["ev"] = ("", """
SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS ts_ns,
       CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
       CASE event_id % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'dns' ELSE 'firefox' END AS log_type
FROM events""")
SQL_VIEWS["named"] = ("ev", """
SELECT *, 'U' || user_id AS subj, (CASE WHEN k % 4 = 0 THEN 'N' ELSE 'K' END) || k AS obj,
       CASE WHEN event_type = 'click' THEN 'EVENT_WRITE' WHEN event_type = 'view' THEN 'EVENT_READ'
            WHEN event_type = 'purchase' THEN 'EVENT_SENDTO' WHEN event_type = 'signup' THEN 'EVENT_EXECUTE'
            WHEN k % 10 = 0 THEN 'EVENT_FLOWS_TO' ELSE 'EVENT_OPEN' END AS kind
FROM ev""")
SQL_VIEWS["edges"] = ("named", """
SELECT event_id AS log_idx, log_type, CASE WHEN kind = 'EVENT_READ' THEN obj ELSE subj END AS src,
       CASE WHEN kind = 'EVENT_READ' THEN subj ELSE obj END AS dst, kind AS action, ts_ns, value,
       strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d_%H') AS window_key
FROM named WHERE kind <> 'EVENT_FLOWS_TO'""")
SQL_VIEWS["edges_big"] = ("", """
SELECT l_orderkey AS log_idx, 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag || l_linestatus AS action,
       epoch_us(l_shipdate) * 1000 AS ts_ns, l_linenumber::BIGINT AS line_no, l_extendedprice AS price
FROM lineitem""")
SQL_VIEWS["dirty"] = ("named", """
SELECT event_id AS log_idx, log_type,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'A: ' || subj WHEN event_id % 23 = 0 THEN subj || '::'
       WHEN event_id % 29 = 0 THEN '4711' WHEN event_id % 31 = 0 THEN 'x'
       WHEN event_id % 37 = 0 THEN 'uri=http://h' || user_id || '/' ELSE subj END AS src,
  CASE WHEN event_id % 13 = 0 THEN subj || ':' WHEN event_id % 41 = 0 THEN 'AAAA: ' || obj
       WHEN event_id % 43 = 0 THEN subj || '7' WHEN event_id % 47 = 0 THEN 'http://h1/' ELSE obj END AS dst,
  CASE WHEN event_id % 11 = 0 THEN '12 34' WHEN event_id % 14 = 0 THEN 'ok' WHEN event_id % 15 = 0 THEN 'Read ' || k
       WHEN event_id % 21 = 0 THEN ':"Write".' WHEN event_id % 22 = 0 THEN '[[Open File]]'
       WHEN event_id % 26 = 0 THEN 'Read Data:Write Data'
       WHEN event_id % 27 = 0 THEN 'Accesses:' || chr(9) || 'ReadData' || chr(9) || 'WriteData'
       WHEN event_id % 33 = 0 THEN 'https GET' WHEN event_id % 34 = 0 THEN subj WHEN event_id % 35 = 0 THEN 'NO LABEL'
       WHEN event_id % 38 = 0 THEN 'First line' || chr(10) || 'Second:   third' WHEN event_id % 39 = 0 THEN 'mode=rw=x'
       ELSE event_type END AS action,
  CASE WHEN event_id % 16 = 0 THEN 'PM' WHEN event_id % 18 = 0 THEN '...' WHEN event_id % 24 = 0 THEN '12'
       WHEN event_id % 25 = 0 THEN 'unknown time'
       WHEN event_id % 28 = 0 THEN 'Time :' || strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S') || ' PM'
       WHEN event_id % 32 = 0 THEN 'at:' || strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S')
       WHEN event_id % 36 = 0 THEN 'click ' || strftime(make_timestamp(ts_ns // 1000), '%H:%M:%S')
       ELSE strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S') END AS ts,
  value, ts_ns
FROM named""")
SQL_VIEWS["names"] = ("", """
SELECT 'C:\\\\srv12\\' || replace(p_brand, '#', '-') || '//' || replace(p_name, ' ', '_') || p_partkey ||
       CASE WHEN p_partkey % 3 = 0 THEN '.' || lower(p_type) WHEN p_partkey % 3 = 1 THEN '.v2.log' ELSE '' END AS name FROM part
UNION ALL SELECT '10.0.' || s_nationkey || '.' || (s_suppkey % 300) || CASE WHEN s_suppkey % 2 = 0 THEN ':' || s_suppkey ELSE '' END
  FROM supplier
UNION ALL SELECT url FROM pages""")
SQL_VIEWS["types"] = ("edges", """
SELECT node, 'type_' || (n % 5) AS vtype, 'func_' || (n % 7) AS functionality
FROM (SELECT node, CAST(substr(node, 2) AS BIGINT) AS n FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))
WHERE n % 3 <> 0""")
SQL_VIEWS["votes"] = ("", """
SELECT l_partkey::VARCHAR AS id, l_returnflag AS value, 'P' || (l_partkey % 40) AS src, 'S' || (l_suppkey % 20) AS dst,
       l_returnflag || l_linestatus AS action, CASE WHEN l_linestatus = 'O' THEN '->' ELSE '<-' END AS direction,
       strftime(l_shipdate, '%Y') AS ts, l_orderkey * 100 + l_linenumber AS seq
FROM lineitem""")
SQL_VIEWS["vecs"] = ("", "SELECT vec_id AS id, embedding AS v, label::BIGINT AS label FROM embeddings")
SQL_VIEWS["scores"] = ("ev", """
SELECT event_id AS id, value AS score, (event_type = 'error')::BIGINT AS y, 'A' || (user_id % 3) AS attack,
       'U' || user_id AS node, log_type, ts_ns, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS day,
       strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d_%H') AS window_key
FROM ev""")
SQL_VIEWS["log_scores"] = ("", """
SELECT d.doc_id AS log_idx, d.lang AS log_type, d.n_chars::DOUBLE AS score, coalesce(l.toxic, 0)::BIGINT AS y,
       d.source AS attack, l.quality IS NOT NULL AS scored
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
SQL_VIEWS["answers"] = ("", """
SELECT conv_id, turn::BIGINT AS turn, role,
  '**Stage: ' || (['Reconnaissance', 'initial access', 'Execution', 'Data Exfiltration', 'Unknown Step'])[turn % 5 + 1] || '**' ||
  chr(10) || '"U' || (conv_id % 150) || '" touched "K' || (turn * 7) || '" and "' || role || '"' || chr(10) ||
  'Reasoning: turn ' || turn || ' of the chain' || chr(10) || '### Final Output' || chr(10) || 'U' || (conv_id % 150) || ' = ' ||
  role || chr(10) || '(U1, K2) A: [...]' || chr(10) || 'Filename: a' || turn || ' | Classification: ' ||
  CASE turn % 3 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'valid' ELSE 'Command-Line' END || ' | Type: tool' || chr(10) ||
  '<think>draft</think>' || CASE WHEN conv_id % 3 = 0 THEN 'Yes' ELSE 'no' END || ' because YES' || chr(10) || text AS text
FROM conversations""")
