"""Recorded exchanges with servers as sources: what they list and what reading it gave, whatever the transport.

An exchange is a row (server, method, uri, answer): a JSON-RPC request by its method, and by its uri for resources/read, and the answer's text; null if none
came in time. Talking to servers is not the engine's: a recorder writes these rows, one partition for each server if it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .entities import prompts, tools

EXCHANGE = "server string, method string, uri string, answer string"
MISSING = ("unsupported", "not implemented", "method not found", "does not have", "methodnotfound", "doesn't have")
TIMEOUT_SECONDS = 60


def unsupported(answer: Column) -> Column:
    """Whether an error says that the server lacks the capability: by its code, by what a dropped session looks like, or by its words."""
    code, said = F.get_json_object(answer, "$.error.code"), F.lower(F.coalesce(F.get_json_object(answer, "$.error.message"), F.lit("")))
    words = F.lit(False)
    for w in MISSING:
        words = words | F.contains(said, F.lit(w))
    return F.coalesce((code == "-32601") | ((code == "32600") & F.contains(said, F.lit("session terminated"))) | words, F.lit(False))


def listings(log: DataFrame, kind: str) -> DataFrame:
    """(server, status, answer) of each server's listing of tools, prompts or resources. A capability that the server doesn't announce, or says it lacks, is
    unsupported, which is no error; a server without a first exchange may still answer."""
    caps = log.filter("method = 'initialize'").groupBy("server").agg(F.max(F.get_json_object("answer", "$.result.capabilities")).alias("caps"))
    asked = log.filter(F.col("method") == f"{kind}/list").groupBy("server").agg(F.max("answer").alias("answer"), F.lit(True).alias("asked"))
    both = log.select("server").distinct().join(caps, "server", "left").join(asked, "server", "left")
    announced = F.col("caps").isNull() | F.get_json_object("caps", f"$.{kind}").isNotNull()
    failed = F.get_json_object("answer", "$.result").isNull()
    status = F.when(~announced, "unsupported").when(failed & unsupported(F.col("answer")), "unsupported").when(failed, "failed").otherwise("completed")
    return both.filter(F.col("asked") | ~announced).select("server", status.alias("status"), "answer")


def _items(log: DataFrame, kind: str) -> DataFrame:
    return listings(log, kind).filter("status = 'completed'").select(F.col("server").alias("file"), F.get_json_object("answer", "$.result").alias("j"))


def listed_tools(log: DataFrame) -> DataFrame:
    return tools(_items(log, "tools")).withColumnRenamed("file", "server")


def listed_prompts(log: DataFrame) -> DataFrame:
    return prompts(_items(log, "prompts")).withColumnRenamed("file", "server")


def listed_resources(log: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(server, pos, uri, name, content, status): each listed resource with the text parts that reading it gave. Types that aren't allowed are skipped without being
    read, a missing type passes; a read that failed, or never came, is failed; one without text is skipped."""
    kind = "resources array<struct<uri:string,name:string,mimeType:string>>"
    listed = _items(log, "resources").select(F.col("file").alias("server"), F.posexplode(F.from_json("j", kind)["resources"]).alias("pos", "r")).select("server", "pos", "r.*")
    reads = log.filter("method = 'resources/read'").groupBy("server", "uri").agg(F.max("answer").alias("answer"))
    parts = F.from_json(F.get_json_object("answer", "$.result.contents"), "array<struct<text:string>>")
    content = F.array_join(F.array_compact(F.transform(parts, lambda p: p["text"])), "\n")
    both = listed.join(reads, ["server", "uri"], "left")
    refused = F.lit(False) if allowed is None else F.col("mimeType").isNotNull() & ~F.col("mimeType").isin(*allowed)
    status = F.when(refused, "skipped").when(parts.isNull(), "failed").when(F.length(content) == 0, "skipped").otherwise("completed")
    return both.select("server", "pos", "uri", "name", F.when(status == "completed", content).alias("content"), status.alias("status"))


def stdio_exchanges(lines: DataFrame, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """Captured lines (server, at timestamp, sent boolean, line) of child processes -> EXCHANGE rows. Lines that aren't JSON-RPC are the child's chatter; an answer
    belongs to the request of its id, and one that comes later than the timeout counts as none."""
    j = lambda p: F.get_json_object("line", p)
    rpc = lines.filter(F.trim("line").startswith("{") & (j("$.jsonrpc") == "2.0") & j("$.id").isNotNull())
    asked = rpc.filter("sent").select("server", j("$.id").alias("id"), F.col("at").alias("asked"), j("$.method").alias("method"), j("$.params.uri").alias("uri"))
    said = rpc.filter("not sent").select("server", j("$.id").alias("id"), F.col("at").alias("said"), "line")
    first = W.partitionBy("server", "id").orderBy("said")
    said = said.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    late = F.col("said").cast("double") - F.col("asked").cast("double") > timeout
    return asked.join(said, ["server", "id"], "left").select("server", "method", "uri", F.when(~late, F.col("line")).alias("answer"))


def headers(servers: DataFrame) -> DataFrame:
    """servers (server, auth, token, header, extra map, relay map) with the headers they are asked with: an API key under its header, a bearer or OAuth token as
    Authorization; extra headers stay unless authentication sets them, and what a proxy relays comes last. `shown` is for logs, without secrets."""
    none = F.create_map().cast("map<string,string>")
    key = F.coalesce("header", F.lit("X-API-Key"))
    own = F.when(F.col("token").isNull(), none).when(F.lower("auth") == "apikey", F.create_map(key, F.col("token"))).when(F.lower("auth").isin("bearer", "oauth"), F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), "token"))).otherwise(none)
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.exists(F.map_keys(b), lambda x: F.lower(x) == F.lower(k))), b)
    sent = over(over(F.coalesce("extra", none), own), F.coalesce("relay", none))
    secret = lambda k: F.lower(k).rlike("authorization|key|token|secret|cookie")
    line = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), F.when(secret(e["key"]), "***").otherwise(e["value"])))), "\n")
    return servers.select("server", sent.alias("headers"), line(sent).alias("shown"))
