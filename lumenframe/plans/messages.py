"""Registered queries over protocol messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import protocol
from lumenframe.functions import values
from lumenframe.operators import lookup
from lumenframe.plans.registry import query
from lumenframe.plans.tables import spread, table
from lumenframe.sources import part10, web


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def contexts(*own: Column) -> Column:
    return F.array(*own).cast(f"array<{protocol.CONTEXT}>")


@query
def associate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' association requests with roles and identities, every ninth with an even context, written and read."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    key = F.col("c_custkey")
    context = F.struct(F.when(F.pmod(key, F.lit(9)) == 0, 2).otherwise(F.pmod(key, F.lit(100)) * 2 + 1).cast("int").alias("id"), F.concat(F.lit("1.2."), "c_nationkey").alias("abstract_syntax"), F.array(F.lit("1.2.840.10008.1.2"), F.concat(F.lit("1.9."), key)).alias("transfer_syntaxes"), null("string").alias("result"), null("string").alias("transfer_syntax"))
    role = F.struct(F.concat(F.lit("1.2."), "c_nationkey").alias("sop_class"), (F.pmod(key, F.lit(2)) == 0).alias("scu"), (F.pmod(key, F.lit(3)) == 0).alias("scp"))
    identity = F.struct(F.when(F.pmod(key, F.lit(2)) == 0, "username").otherwise("username_password").alias("kind"), F.encode("c_name", "UTF-8").alias("primary"), F.when(F.pmod(key, F.lit(2)) == 1, F.encode(key.cast("string"), "UTF-8")).alias("secondary"), F.lit(True).alias("response"))
    user = F.struct((key + 20000).cast("long").alias("maximum"), F.lit("1.2.3").alias("implementation_class"), F.lit("V1").alias("implementation_version"), F.struct(F.lit(3).alias("invoked"), F.lit(4).alias("performed")).alias("window"), F.array(role).alias("roles"), F.when(F.pmod(key, F.lit(4)) < 3, identity).alias("identity"))
    pdu = F.struct(F.lit("associate_rq").alias("type"), F.substring("c_mktsegment", 1, 16).alias("called"), F.lit("ME").alias("calling"), F.array(context).alias("contexts"), user.alias("user"))
    sent = protocol.encode_pdus(c.select("c_custkey", pdu.alias("pdu"))).withColumnRenamed("status", "sent")
    got = protocol.decode_messages(sent)
    first, role_, who = F.get("pdu.contexts", F.lit(0)), protocol.role_of(F.col("pdu.user.roles"), F.get("pdu.contexts", F.lit(0))["abstract_syntax"]), F.col("pdu.user.identity")
    return got.select("c_custkey", "sent", "status", "pdu.type", "pdu.called", first["id"].cast("string").alias("context"), F.array_join(first["transfer_syntaxes"], ",").alias("syntaxes"), F.col("pdu.user.maximum").cast("string").alias("maximum"), F.col("pdu.user.window.performed").cast("string").alias("performed"), role_["scp"].cast("string").alias("scp"), who["kind"].alias("kind"), F.decode(who["primary"], "UTF-8").alias("who"), F.decode(who["secondary"], "UTF-8").alias("password"))


@query
def accept_and_abort_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptances, rejections, releases and aborts; an unknown type and a short message are refused."""
    e = spread(table(spark, sf_dir, "events").select("event_id"), "event_id")
    kind = F.pmod("event_id", F.lit(5)).cast("int")
    context = F.struct(F.lit(5).alias("id"), null("string").alias("abstract_syntax"), null("array<string>").alias("transfer_syntaxes"), F.when(F.pmod("event_id", F.lit(2)) == 0, "acceptance").otherwise("no_reason").alias("result"), F.lit("1.2.840.10008.1.2").alias("transfer_syntax"))
    number = lambda k, x: F.when(kind.isin(*k), x).cast("int")
    pdu = F.struct(F.element_at(F.array(*[F.lit(x) for x in ("associate_ac", "associate_rj", "release_rq", "release_rp", "abort")]), kind + 1).alias("type"), F.lit("A").alias("called"), F.lit("B").alias("calling"), contexts(context).alias("contexts"), number((1,), F.lit(2)).alias("result"), number((1, 4), F.lit(2)).alias("source"), number((1, 4), F.pmod("event_id", F.lit(7))).alias("reason"))
    sent = protocol.encode_pdus(e.select("event_id", pdu.alias("pdu"))).drop("status")
    third = F.pmod("event_id", F.lit(3))
    broken = sent.withColumn("payload", F.when(third == 1, F.concat(F.lit(b"\x09"), F.expr("substring(payload, 2, length(payload))"))).when(third == 2, F.expr("substring(payload, 1, length(payload) - 1)")).otherwise(F.col("payload")))
    got = protocol.decode_messages(broken)
    return got.select("event_id", "status", "pdu.type", F.get("pdu.contexts", F.lit(0))["result"].alias("result"), F.col("pdu.source").cast("string").alias("source"), F.col("pdu.reason").cast("string").alias("reason"))


NAMES = ("c_echo_rq", "c_echo_rsp", "c_store_rq", "c_store_rsp", "c_find_rq", "c_find_rsp", "c_move_rq", "c_move_rsp", "c_get_rq", "c_get_rsp", "c_cancel_rq")


@query
def command_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as all eleven commands, encoded as command sets and decoded."""
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod("o_orderkey", F.lit(11)) + 1).cast("int"))
    number = lambda x: F.pmod(x, F.lit(65536)).cast("int")
    own = F.struct(name.alias("command"), number(F.col("o_orderkey")).alias("message_id"), number(F.col("o_orderkey") + 1).alias("responded_to"), F.concat(F.lit("1.2."), "o_custkey").alias("sop_class"), F.concat(F.lit("1.2.3."), "o_orderkey").alias("sop_instance"), F.lit("DEST").alias("destination"), F.lit(0xFF00).alias("status"), (F.pmod("o_orderkey", F.lit(2)) == 0).alias("has_data_set"), *[(F.pmod("o_orderkey", F.lit(10 + k))).cast("int").alias(c) for k, c in enumerate(protocol.COUNTS)])
    got = protocol.decode_commands(protocol.encode_commands(o.select("o_orderkey", own.alias("command"))).drop("status"))
    t = lambda c: F.col(f"command.{c}").cast("string").alias(c)
    return got.select("o_orderkey", F.col("status").alias("decoded"), "command.command", *map(t, ("message_id", "responded_to", "sop_class", "sop_instance", "destination", "status", "has_data_set", *protocol.COUNTS)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(assoc_id, seq, command): line items as responses of their order's C-MOVE or C-GET, those of line 5 final."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    status = F.when(F.col("l_linenumber") == 5, F.when(F.pmod("l_orderkey", F.lit(3)) == 0, 0xB000).otherwise(0)).otherwise(0xFF00)
    own = F.struct(F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "c_move_rsp").otherwise("c_get_rsp").alias("command"), F.pmod("l_orderkey", F.lit(1000)).cast("int").alias("responded_to"), status.cast("int").alias("status"), F.lit(False).alias("has_data_set"), (F.lit(9) - F.col("l_linenumber")).cast("int").alias("remaining"), F.col("l_linenumber").cast("int").alias("completed"), F.pmod("part", F.lit(3)).cast("int").alias("failed"), F.lit(0).alias("warning"))
    sent = protocol.encode_commands(li.select(F.col("l_orderkey").alias("assoc_id"), F.col("l_linenumber").cast("int").alias("seq"), own.alias("command"))).drop("status")
    return protocol.decode_commands(sent).where("status = 'ok'").drop("status")


@query
def retrieve_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each retrieval up to its final response, and the counters that were sent."""
    found = protocol.retrieve_progress(responses(spark, sf_dir), ["assoc_id"], "seq")
    steps = F.transform("progress", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["remaining"].cast("string"), x["failed"].cast("string")))
    return found.select(F.col("assoc_id").alias("l_orderkey"), F.col("message_id").cast("long").alias("message_id"), F.array_join(steps, ",").alias("progress"), F.col("final_status").cast("string").alias("final_status"), "category", F.col("completed").cast("string").alias("completed"))


@query
def association_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of PDUs by order: a request, an answer, data by the line item, and an end; some come out of turn."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.pmod("o_orderkey", F.lit(6))
    end = F.when(k == 2, F.array(F.lit("abort"))).when(k == 3, F.array(F.lit("release_rq"))).when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("release_rq"), F.lit("release_rq"), F.lit("release_rp")))
    begin = F.when(k == 0, F.array(F.lit("associate_rq"), F.lit("associate_rj"))).when(k == 5, F.array(F.lit("associate_ac"))).otherwise(F.array(F.lit("associate_rq"), F.lit("associate_ac")))
    control = o.select("o_orderkey", F.posexplode(begin).alias("i", "type")).select("o_orderkey", F.col("i").alias("seq"), "type")
    control = control.unionByName(o.where("pmod(o_orderkey, 6) not in (0, 5)").select("o_orderkey", F.posexplode(end).alias("i", "type")).select("o_orderkey", (F.col("i") + 1000).alias("seq"), "type"))
    data = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") + 10).cast("int").alias("seq"), F.lit("p_data").alias("type"))
    return protocol.association_states(control.unionByName(data), ["o_orderkey"], "seq").select("o_orderkey", "state", F.col("violation").cast("string").alias("violation"), "n_data")


@query
def negotiated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that customers ask for, granted as the policy has it, and looked up again by SOP class."""
    c = table(spark, sf_dir, "customer")
    uid = F.concat(F.lit("1.9."), F.col("c_nationkey"))
    context = F.array(F.struct(F.lit(1).alias("id"), uid.alias("abstract_syntax"), F.array(F.lit("ts1")).alias("transfer_syntaxes")))
    roles = F.array(F.struct(uid.alias("sop_class"), F.lit(True).alias("scu"), F.lit(True).alias("scp")), F.struct(F.lit("1.9.0").alias("sop_class"), F.lit(False).alias("scu"), F.lit(True).alias("scp")))
    requests = c.select(F.col("c_custkey").alias("assoc_id"), F.lit(protocol.APPLICATION_CONTEXT).alias("application_context"), F.lit("X").alias("called"), context.alias("contexts"), roles.alias("roles"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("1.9."), F.col("n_nationkey")).alias("uid"))
    transfer = spark.createDataFrame([("ts1", 0)], "uid string, preference int")
    _, _, granted = protocol.negotiated(requests, None, nations.where("n_nationkey % 2 = 0").select("uid"), transfer, nations.where("n_nationkey % 4 = 0").select("uid"))
    per = granted.groupBy("assoc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sop_class", "scu", "scp"))).alias("roles"))
    back = c.select(F.col("c_custkey").alias("assoc_id"), uid.alias("uid")).join(per, "assoc_id", "left")
    role = protocol.role_of(F.col("roles"), F.col("uid"))
    return back.select(F.col("assoc_id").alias("c_custkey"), F.coalesce(F.size("roles"), F.lit(0)).cast("long").alias("n"), role["scu"].cast("string").alias("scu"), role["scp"].cast("string").alias("scp"))


@query
def command_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to echo and store requests, encoded and decoded; every fourth store fails."""
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("c_echo_rq", "c_store_rq", "c_find_rq")]), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    own = F.struct(name.alias("command"), F.pmod("o_orderkey", F.lit(65536)).cast("int").alias("message_id"), F.lit("1.2").alias("sop_class"), F.lit("1.2.3").alias("sop_instance"))
    asked = protocol.decode_commands(protocol.encode_commands(o.select("o_orderkey", own.alias("command"))).drop("status")).drop("status")
    said = protocol.answers(asked, F.when(F.pmod("o_orderkey", F.lit(4)) == 0, 0xA700).otherwise(0))
    got = protocol.decode_commands(protocol.encode_commands(said).drop("status")).drop("status")
    return got.select("o_orderkey", "command.command", F.col("command.responded_to").cast("long").alias("responded_to"), F.col("command.status").cast("long").alias("status"))


@query
def web_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, instances and frames of customers as DICOMweb addresses; frame numbers below one have none."""
    c = table(spark, sf_dir, "customer")
    study, key = F.concat(F.lit("1.2."), F.col("c_nationkey")), F.col("c_custkey").cast("string")
    search = web.search_url("http://pacs/rs/", "series", study, query=F.create_map(F.lit("PatientName"), F.concat("c_name", F.lit(" &x")), F.lit("Modality"), F.lit("CT")), limit=10, offset=5)
    numbers = F.array(F.col("c_nationkey").cast("int"), F.lit(2))
    return c.select("c_custkey", search.alias("search"), web.instance_url("http://pacs/rs", study, F.lit("1.3"), key, "metadata").alias("metadata"), web.frames_url("http://pacs/rs", study, F.lit("1.3"), key, numbers).alias("frames"))


def echoed(method: str, address: str, headers: dict, body: bytes | None) -> tuple[int, dict, bytes]:
    """A transport without a network: what a small archive would answer, by the last part of the address."""
    key = int(address.rsplit("/", 1)[-1])
    if key % 5 == 0:
        return 404, {}, b""
    if key % 7 == 0:
        return 503, {}, b""
    text = '[{"00100020":{"vr":"LO","Value":["%d"]}},{"00100020":{"vr":"LO","Value":["second"]}}]' % key
    return 200, {"content-type": headers.get("Accept", "")}, text.encode()


@query
def web_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a transport as decoded rows: what was not found or failed for good has its status."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file_id"), web.url("http://pacs", F.col("c_custkey")).alias("url"), F.lit(web.JSON).alias("accept"))
    got = web.performed(c, echoed, attempts=3)
    files = web.found(got).select(F.split("file_id", "#")[0].alias("file_id"), values.text(lookup.attribute("elements", "PatientID")["value"]).alias("id"))
    ids = files.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return got.join(ids, "file_id", "left").select(F.col("file_id").cast("long").alias("c_custkey"), "status", F.col("code").cast("long").alias("code"), F.col("attempts").cast("long").alias("attempts"), "ids")


@query
def retry_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.pmod("event_id", F.lit(400)) + 200).cast("int").alias("status"))
    return e.select("event_id", protocol.should_retry(F.col("status")).cast("string").alias("again"))


@query
def multipart_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the first of two parts of a multipart body; every fifth content type names no boundary."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    bodies = part10.multipart_bodies(d.select("file_id", F.array("content", F.lit(b"second")).alias("parts")), "mark-x")
    kind = F.when(F.pmod(F.col("file_id").cast("long"), F.lit(5)) == 0, "multipart/related").otherwise('multipart/related; type="application/dicom"; boundary="mark-x"')
    found = part10.first_parts(bodies.withColumn("content_type", kind))
    return found.select(F.col("file_id").cast("long").alias("doc_id"), "status", F.sha2("content", 256).alias("content"))


SQL = {
    "associate_roundtrip": """
WITH c AS (SELECT *, c_custkey % 9 <> 0 AS ok FROM customer)
SELECT c_custkey, CASE WHEN ok THEN 'ok' ELSE 'invalidPresentationContext' END AS sent, CASE WHEN ok THEN 'ok' ELSE 'malformedPDU' END AS status, CASE WHEN ok THEN 'associate_rq' END AS type, CASE WHEN ok THEN c_mktsegment END AS called,
       CASE WHEN ok THEN ((c_custkey % 100) * 2 + 1)::VARCHAR END AS context, CASE WHEN ok THEN '1.2.840.10008.1.2,1.9.' || c_custkey END AS syntaxes, CASE WHEN ok THEN (c_custkey + 20000)::VARCHAR END AS maximum, CASE WHEN ok THEN '4' END AS performed,
       CASE WHEN ok THEN CASE c_custkey % 3 WHEN 0 THEN 'true' ELSE 'false' END END AS scp,
       CASE WHEN ok AND c_custkey % 4 < 3 THEN CASE c_custkey % 2 WHEN 0 THEN 'username' ELSE 'username_password' END END AS kind, CASE WHEN ok AND c_custkey % 4 < 3 THEN c_name END AS who, CASE WHEN ok AND c_custkey % 4 = 1 THEN c_custkey::VARCHAR END AS password FROM c""",
    "accept_and_abort_roundtrip": """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'unsupportedPDU' ELSE 'malformedPDU' END AS status,
       CASE WHEN event_id % 3 = 0 THEN CASE event_id % 5 WHEN 0 THEN 'associate_ac' WHEN 1 THEN 'associate_rj' WHEN 2 THEN 'release_rq' WHEN 3 THEN 'release_rp' ELSE 'abort' END END AS type,
       CASE WHEN event_id % 15 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'acceptance' ELSE 'no_reason' END END AS result,
       CASE WHEN event_id % 3 = 0 AND event_id % 5 IN (1, 4) THEN '2' END AS source, CASE WHEN event_id % 3 = 0 AND event_id % 5 IN (1, 4) THEN (event_id % 7)::VARCHAR END AS reason FROM events""",
    "command_roundtrip": """
WITH o AS (SELECT *, o_orderkey % 11 AS k FROM orders)
SELECT o_orderkey, 'ok' AS decoded, ['c_echo_rq', 'c_echo_rsp', 'c_store_rq', 'c_store_rsp', 'c_find_rq', 'c_find_rsp', 'c_move_rq', 'c_move_rsp', 'c_get_rq', 'c_get_rsp', 'c_cancel_rq'][k + 1] AS command,
       CASE WHEN k IN (0, 2, 4, 6, 8) THEN (o_orderkey % 65536)::VARCHAR END AS message_id, CASE WHEN k NOT IN (0, 2, 4, 6, 8) THEN ((o_orderkey + 1) % 65536)::VARCHAR END AS responded_to,
       CASE WHEN k IN (2, 4, 6, 8) THEN '1.2.' || o_custkey END AS sop_class, CASE WHEN k = 2 THEN '1.2.3.' || o_orderkey END AS sop_instance, CASE WHEN k = 6 THEN 'DEST' END AS destination, CASE WHEN k IN (1, 3, 5, 7, 9) THEN '65280' END AS status,
       CASE WHEN k IN (2, 4, 6, 8) OR (k IN (5, 7, 9) AND o_orderkey % 2 = 0) THEN 'true' ELSE 'false' END AS has_data_set,
       CASE WHEN k IN (5, 7, 9) THEN (o_orderkey % 10)::VARCHAR END AS remaining, CASE WHEN k IN (5, 7, 9) THEN (o_orderkey % 11)::VARCHAR END AS completed, CASE WHEN k IN (5, 7, 9) THEN (o_orderkey % 12)::VARCHAR END AS failed, CASE WHEN k IN (5, 7, 9) THEN (o_orderkey % 13)::VARCHAR END AS warning FROM o""",
    "retrieve_progress": """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, bool_or(n = 5) AS ended FROM l GROUP BY l_orderkey)
SELECT l_orderkey, (l_orderkey % 1000)::BIGINT AS message_id, coalesce(string_agg(n || ':' || (9 - n) || ':' || (part % 3), ',' ORDER BY n) FILTER (WHERE n <> 5 AND (NOT ended OR n < 5)), '') AS progress,
       CASE WHEN ended THEN CASE l_orderkey % 3 WHEN 0 THEN '45056' ELSE '0' END END AS final_status, CASE WHEN ended THEN CASE l_orderkey % 3 WHEN 0 THEN 'warning' ELSE 'success' END END AS category, CASE WHEN ended THEN '5' END AS completed
FROM l JOIN f USING (l_orderkey) GROUP BY l_orderkey, ended""",
    "association_states": """
WITH d AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN c THEN ['rejected', 'released', 'aborted', 'releasing', 'established', 'aborted'][o_orderkey % 6 + 1] ELSE 'idle' END AS state,
       CASE WHEN NOT c OR o_orderkey % 6 = 5 OR (o_orderkey % 6 = 0 AND coalesce(n, 0) > 0) THEN 'true' ELSE 'false' END AS violation, coalesce(n, 0)::BIGINT AS n_data
FROM (SELECT o_orderkey, true AS c FROM orders UNION SELECT l_orderkey, false FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) LEFT JOIN d USING (o_orderkey)""",
    "negotiated_roles": """
SELECT c_custkey, (1 + (c_nationkey % 2 = 0)::INTEGER)::BIGINT AS n, CASE WHEN c_nationkey % 2 = 0 THEN 'true' END AS scu,
       CASE WHEN c_nationkey % 2 = 0 THEN CASE c_nationkey % 4 WHEN 0 THEN 'true' ELSE 'false' END END AS scp FROM customer""",
    "command_answers": """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'c_echo_rsp' ELSE 'c_store_rsp' END AS command, (o_orderkey % 65536)::BIGINT AS responded_to,
       CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN 42752 ELSE 0 END::BIGINT AS status FROM orders WHERE o_orderkey % 3 < 2""",
    "web_addresses": """
SELECT c_custkey, 'http://pacs/rs/studies/1.2.' || c_nationkey || '/series?Modality=CT&PatientName=' || replace(c_name, '#', '%23') || '%20%26x&limit=10&offset=5' AS search,
       'http://pacs/rs/studies/1.2.' || c_nationkey || '/series/1.3/instances/' || c_custkey || '/metadata' AS metadata,
       CASE WHEN c_nationkey > 0 THEN 'http://pacs/rs/studies/1.2.' || c_nationkey || '/series/1.3/instances/' || c_custkey || '/frames/' || c_nationkey || ',2' END AS frames FROM customer""",
    "web_searches": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'unsuccessfulHTTPStatus' ELSE 'ok' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 404 WHEN c_custkey % 7 = 0 THEN 503 ELSE 200 END::BIGINT AS code,
       CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 3 ELSE 1 END::BIGINT AS attempts, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_custkey || ',second' END AS ids FROM customer""",
    "retry_statuses": "SELECT event_id, CASE WHEN event_id % 400 + 200 = 429 OR event_id % 400 + 200 BETWEEN 500 AND 599 THEN 'true' ELSE 'false' END AS again FROM events",
    "multipart_bodies": """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'invalidMultipartResponse' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 <> 0 THEN sha256(coalesce(text, '')) END AS content FROM documents""",
}
