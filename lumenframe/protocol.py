"""Messages of the DICOM upper layer (PS3.8) and of DIMSE (PS3.7): bytes to structures and back.

Layouts are tables: a sub-item or command says which fields it has and how each is coded. Sockets are not part of
this library; what it reads are logs and landing zones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lumenframe.arrow import mapped
from lumenframe.binary import python_values
from lumenframe.operators.lookup import small

# Fixed values of PS3.7/PS3.8.
APPLICATION_CONTEXT = "1.2.840.10008.3.1.1.1"
DEFAULT_MAXIMUM = 16384
PDU_TYPES = {1: "associate_rq", 2: "associate_ac", 3: "associate_rj", 4: "p_data", 5: "release_rq", 6: "release_rp", 7: "abort"}
PDU_CODES = {v: k for k, v in PDU_TYPES.items()}
CONTEXT_RESULTS = {0: "acceptance", 1: "user_rejection", 2: "no_reason", 3: "abstract_syntax_not_supported", 4: "transfer_syntaxes_not_supported"}
IDENTITY_KINDS = {1: "username", 2: "username_password", 3: "kerberos", 4: "saml", 5: "jwt"}


class ProtocolError(ValueError):
    """Bytes that are not a message, or a message that has no bytes."""


def fail(kind: str = "malformedPDU"):
    raise ProtocolError(kind)


def item(kind: int, body: bytes) -> bytes:
    return struct.pack(">BxH", kind, len(body)) + body if len(body) < 65536 else fail("pduTooLarge")


def items(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at < len(data):
        if len(data) - at < 4:
            fail()
        kind, size = struct.unpack_from(">BxH", data, at)
        at += 4
        if size > len(data) - at:
            fail()
        yield kind, data[at : at + size]
        at += size


def prefixed(body: bytes) -> bytes:
    return struct.pack(">H", len(body)) + body if len(body) < 65536 else fail("pduTooLarge")


def ascii_text(raw: bytes, kind: str = "malformedPDU") -> str:
    try:
        return raw.decode("ascii")
    except UnicodeDecodeError:
        return fail(kind)


def title(name: str) -> bytes:
    raw = name.encode()
    return raw.ljust(16) if len(raw) <= 16 and all(32 <= b <= 126 for b in raw) else fail("invalidAETitle")


def encode_identity(identity: dict) -> bytes:
    """kind, primary, secondary (bytes), response (asked for)."""
    kind = next(k for k, v in IDENTITY_KINDS.items() if v == identity["kind"])
    first, second = identity["primary"], identity.get("secondary") or b""
    if 6 + len(first) + len(second) > 65535:
        fail("pduTooLarge")
    return bytes([kind, bool(identity.get("response"))]) + prefixed(first) + prefixed(second)


def decode_identity(raw: bytes) -> dict:
    if len(raw) < 6 or raw[0] not in IDENTITY_KINDS:
        fail()
    n = struct.unpack_from(">H", raw, 2)[0]
    if len(raw) < 6 + n:
        fail()
    first, m = raw[4 : 4 + n], struct.unpack_from(">H", raw, 4 + n)[0]
    second = raw[6 + n :]
    if len(second) != m or (m and raw[0] != 2):
        fail()
    if raw[0] != 3:
        try:
            first.decode(), second.decode()
        except UnicodeDecodeError:
            fail()
    return {"kind": IDENTITY_KINDS[raw[0]], "primary": first, "secondary": second if raw[0] == 2 else None, "response": bool(raw[1])}


def even(raw: bytes, pad: bytes) -> bytes:
    return raw + pad * (len(raw) % 2)


def encode_user(info: dict) -> bytes:
    """Sub-items of the user information, in the order of the standard's tables."""
    out = item(0x51, struct.pack(">I", info.get("maximum", DEFAULT_MAXIMUM)))
    if info.get("implementation_class"):
        out += item(0x52, even(info["implementation_class"].encode(), b"\0"))
        if info.get("implementation_version"):
            out += item(0x55, even(info["implementation_version"].encode(), b" "))
    if info.get("window"):
        out += item(0x53, struct.pack(">HH", *info["window"]))
    for uid, scu, scp in info.get("roles") or ():
        out += item(0x54, prefixed(uid.encode()) + bytes([bool(scu), bool(scp)]))
    if info.get("identity"):
        out += item(0x58, encode_identity(info["identity"]))
    if info.get("identity_response") is not None:
        out += item(0x59, prefixed(info["identity_response"]))
    return item(0x50, out)


def decode_user(raw: bytes) -> dict:
    out: dict = {"maximum": DEFAULT_MAXIMUM, "roles": []}
    for kind, body in items(raw):
        if kind == 0x51 and len(body) == 4:
            out["maximum"] = struct.unpack(">I", body)[0]
        elif kind == 0x52:
            out["implementation_class"] = ascii_text(body).strip("\0")
        elif kind == 0x55:
            out["implementation_version"] = ascii_text(body).strip(" ")
        elif kind == 0x53:
            out["window"] = struct.unpack(">HH", body) if len(body) == 4 else fail()
        elif kind == 0x54:
            n = struct.unpack_from(">H", body)[0] if len(body) >= 2 else fail()
            if len(body) != n + 4:
                fail()
            out["roles"].append((ascii_text(body[2 : 2 + n]), bool(body[-2]), bool(body[-1])))
        elif kind == 0x58:
            out["identity"] = decode_identity(body)
        elif kind == 0x59:
            if len(body) < 2 or struct.unpack_from(">H", body)[0] != len(body) - 2:
                fail()
            out["identity_response"] = body[2:]
    return out


def encode_pdu(pdu: dict) -> bytes:
    """A PDU from its structure; type is one of PDU_TYPES."""
    kind = pdu["type"]
    if kind in ("associate_rq", "associate_ac"):
        body = struct.pack(">HH", 1, 0) + title(pdu["called"]) + title(pdu["calling"]) + b"\0" * 32 + item(0x10, pdu.get("application_context", APPLICATION_CONTEXT).encode())
        for c in pdu["contexts"]:
            if not 1 <= c["id"] <= 255 or c["id"] % 2 == 0:
                fail("invalidPresentationContext")
            if kind == "associate_rq":
                if not c["abstract_syntax"] or not c["transfer_syntaxes"]:
                    fail("invalidPresentationContext")
                body += item(0x20, bytes([c["id"], 0, 0, 0]) + item(0x30, c["abstract_syntax"].encode()) + b"".join(item(0x40, t.encode()) for t in c["transfer_syntaxes"]))
            else:
                code = next(k for k, v in CONTEXT_RESULTS.items() if v == c["result"])
                body += item(0x21, bytes([c["id"], 0, code, 0]) + item(0x40, c["transfer_syntax"].encode()))
        body += encode_user(pdu.get("user") or {})
    elif kind == "associate_rj":
        body = bytes([0, pdu["result"], pdu["source"], pdu["reason"]])
    elif kind == "p_data":
        body = b"".join(struct.pack(">IBB", len(v["data"]) + 2, v["context"] or fail(), bool(v["last"]) << 1 | bool(v["command"])) + v["data"] for v in pdu["values"])
    elif kind == "abort":
        body = bytes([0, 0, pdu["source"], pdu["reason"]])
    else:
        body = b"\0" * 4
    return struct.pack(">BxI", PDU_CODES[kind], len(body)) + body


def decode_pdu(raw: bytes) -> dict:
    """The structure of exactly one PDU."""
    if len(raw) < 6 or raw[1] or struct.unpack_from(">I", raw, 2)[0] != len(raw) - 6:
        fail()
    if raw[0] not in PDU_TYPES:
        fail("unsupportedPDU")
    kind, body = PDU_TYPES[raw[0]], raw[6:]
    if kind in ("associate_rq", "associate_ac"):
        return {"type": kind, **decode_associate(body, kind == "associate_rq")}
    if kind == "p_data":
        return {"type": kind, "values": list(decode_values(body))}
    if len(body) != 4:
        fail()
    if kind == "associate_rj":
        return {"type": kind, "result": body[1], "source": body[2], "reason": body[3]} if body[0] == 0 and body[1] in (1, 2) and body[2] in (1, 2, 3) else fail()
    return {"type": kind, "source": body[2], "reason": body[3]} if kind == "abort" else {"type": kind}


def decode_associate(body: bytes, request: bool) -> dict:
    if len(body) < 68 or body[:2] != b"\0\1":
        fail()
    called, calling = (ascii_text(body[a : a + 16], "invalidAETitle").strip() for a in (4, 20))
    out: dict = {"called": called, "calling": calling, "contexts": [], "user": {"maximum": DEFAULT_MAXIMUM, "roles": []}}
    for kind, raw in items(body, 68):
        if kind == 0x10:
            out["application_context"] = ascii_text(raw)
        elif kind == (0x20 if request else 0x21):
            if len(raw) < 4 or raw[0] % 2 == 0:
                fail("invalidPresentationContext" if len(raw) >= 4 else "malformedPDU")
            parts = list(items(raw, 4))
            syntaxes = [ascii_text(v) for k, v in parts if k == 0x40]
            if request:
                abstract = [ascii_text(v) for k, v in parts if k == 0x30]
                if not abstract or not syntaxes:
                    fail("invalidPresentationContext")
                out["contexts"].append({"id": raw[0], "abstract_syntax": abstract[-1], "transfer_syntaxes": syntaxes})
            else:
                if raw[2] not in CONTEXT_RESULTS or len(parts) != 1 or not syntaxes:
                    fail("invalidPresentationContext")
                out["contexts"].append({"id": raw[0], "result": CONTEXT_RESULTS[raw[2]], "transfer_syntax": syntaxes[0]})
        elif kind == 0x50:
            out["user"] = decode_user(raw)
    return out if "application_context" in out and out["contexts"] else fail()


def decode_values(body: bytes) -> Iterator[dict]:
    at = 0
    while at < len(body):
        if len(body) - at < 6:
            fail()
        size, context, control = struct.unpack_from(">IBB", body, at)
        if size < 2 or size > len(body) - at - 4 or not context or control > 3:
            fail()
        yield {"context": context, "command": bool(control & 1), "last": bool(control & 2), "data": body[at + 6 : at + 4 + size]}
        at += 4 + size


# DIMSE command fields of PS3.7 annex E, as tag: (name, coding).
FIELDS = {0x0002: ("sop_class", "ui"), 0x0100: ("field", "us"), 0x0110: ("message_id", "us"), 0x0120: ("responded_to", "us"), 0x0600: ("destination", "ae"), 0x0700: ("priority", "us"), 0x0800: ("data_set_type", "us"), 0x0900: ("status", "us"), 0x0902: ("error_comment", "lo"), 0x1000: ("sop_instance", "ui"), 0x1020: ("remaining", "us"), 0x1021: ("completed", "us"), 0x1022: ("failed", "us"), 0x1023: ("warning", "us")}
#: Command codes with the fields that each must have; those of a response with a data set may differ in its type.
COMMANDS = {
    0x0030: ("c_echo_rq", ("message_id",), False),
    0x8030: ("c_echo_rsp", ("responded_to", "status"), False),
    0x0001: ("c_store_rq", ("sop_class", "message_id", "priority", "sop_instance"), True),
    0x8001: ("c_store_rsp", ("responded_to", "status"), False),
    0x0020: ("c_find_rq", ("sop_class", "message_id", "priority"), True),
    0x8020: ("c_find_rsp", ("responded_to", "status"), None),
    0x0021: ("c_move_rq", ("sop_class", "message_id", "destination", "priority"), True),
    0x8021: ("c_move_rsp", ("responded_to", "status"), None),
    0x0010: ("c_get_rq", ("sop_class", "message_id", "priority"), True),
    0x8010: ("c_get_rsp", ("responded_to", "status"), None),
    0x0FFF: ("c_cancel_rq", ("responded_to",), False),
}
COMMAND_CODES = {name: code for code, (name, _, _) in COMMANDS.items()}
NO_DATA_SET = 0x0101
COUNTS = ("remaining", "completed", "failed", "warning")


def encode_command(command: dict) -> bytes:
    """A command set in Implicit VR Little Endian with its group length. has_data_set matters for find, move and get responses."""
    code = COMMAND_CODES[command["command"]]
    _, needed, data = COMMANDS[code]
    own = {"priority": 0, **command, "field": code, "data_set_type": 0 if data or (data is None and command.get("has_data_set")) else NO_DATA_SET}
    names = {*needed, "field", "data_set_type", *(() if data is not None else ("error_comment", *COUNTS))}
    body = b""
    for tag, (name, coding) in FIELDS.items():
        if name not in names or own.get(name) is None:
            continue
        value = own[name]
        if coding == "us":
            raw = struct.pack("<H", value)
        elif coding == "ui":
            raw = even(value.encode(), b"\0")
        else:
            raw = value.encode().ljust(16) if coding == "ae" else even(value.encode(), b" ")
            if coding == "ae" and len(raw) > 16:
                fail("malformedCommandSet")
        body += struct.pack("<HHI", 0, tag, len(raw)) + raw
    return struct.pack("<HHII", 0, 0, 4, len(body)) + body


def decode_command(raw: bytes) -> dict:
    values, at = {}, 0
    while at < len(raw):
        if len(raw) - at < 8:
            fail("malformedCommandSet")
        group, tag, size = struct.unpack_from("<HHI", raw, at)
        at += 8
        if size > len(raw) - at:
            fail("malformedCommandSet")
        if group == 0 and tag in FIELDS:
            name, coding = FIELDS[tag]
            body = raw[at : at + size]
            values[name] = (struct.unpack("<H", body)[0] if size == 2 else None) if coding == "us" else body.decode("utf-8", "replace").rstrip("\0 ").lstrip(" " if coding == "ae" else "")
        at += size
    code = values.get("field")
    if code is None:
        fail("malformedCommandSet")
    if code not in COMMANDS:
        fail("unsupportedCommand")
    name, needed, data = COMMANDS[code]
    if any(values.get(n) is None for n in needed if n != "priority") or values.get("data_set_type") is None:
        fail("malformedCommandSet")
    kind = values["data_set_type"]
    if data is True and kind != 0 or data is False and kind != NO_DATA_SET:
        fail("malformedCommandSet")
    out = {"command": name, "has_data_set": kind != NO_DATA_SET, **{n: values[n] for n in needed if n != "priority"}}
    if data is None:
        out["error_comment"] = values.get("error_comment")
        if all(values.get(c) is not None for c in COUNTS):
            out |= {c: values[c] for c in COUNTS}
    return out


def status_category(code: Column) -> Column:
    """Category of a DIMSE status."""
    return (
        F.when(code == 0, "success")
        .when(code.isin(0xFF00, 0xFF01), "pending")
        .when(code == 0xFE00, "cancel")
        .when(code.isin(0x0001, 0x0107, 0x0116) | code.between(0xB000, 0xBFFF), "warning")
        .when(code.isNotNull(), "failure")
    )


def decode_pdus(log: DataFrame, payload: str = "payload") -> DataFrame:
    """P-DATA fragments of a log of PDUs: the log's keys, pdv (index in the PDU), context, command, last, data, status."""
    keys = [c for c in log.columns if c != payload]
    kinds = dict(log.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["type string", "pdv int", "context int", "command boolean", "last boolean", "data binary", "status string"])

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*map(python_values, batch.columns), strict=True)):
                raw = row.pop(payload)
                try:
                    pdu = decode_pdu(raw or b"")
                except ProtocolError as e:
                    out.append({**row, "status": str(e)})
                    continue
                parts = pdu.get("values") or [{}]
                out += [{**row, "type": pdu["type"], "pdv": k, **v, "status": "ok"} for k, v in enumerate(parts)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return mapped(log.select(*keys, payload), run, schema)


CONTEXT = "struct<id:int,abstract_syntax:string,transfer_syntaxes:array<string>,result:string,transfer_syntax:string>"
IDENTITY = "struct<kind:string,primary:binary,secondary:binary,response:boolean>"
USER = f"struct<maximum:long,implementation_class:string,implementation_version:string,window:struct<invoked:int,performed:int>,roles:array<struct<sop_class:string,scu:boolean,scp:boolean>>,identity:{IDENTITY},identity_response:binary>"
PDU = f"struct<type:string,called:string,calling:string,application_context:string,contexts:array<{CONTEXT}>,user:{USER},result:int,source:int,reason:int,values:array<struct<context:int,command:boolean,last:boolean,data:binary>>>"
COMMAND = "struct<command:string,message_id:int,responded_to:int,sop_class:string,sop_instance:string,destination:string,priority:int,status:int,has_data_set:boolean,error_comment:string,remaining:int,completed:int,failed:int,warning:int>"


def given(value):
    """A structure without its NULL fields."""
    if isinstance(value, dict):
        return {k: given(v) for k, v in value.items() if v is not None}
    return [given(v) for v in value] if isinstance(value, list) else value


def pdu_bytes(row: dict) -> bytes:
    own = given(row)
    if user := own.get("user"):
        if "window" in user:
            user["window"] = user["window"]["invoked"], user["window"]["performed"]
        user["roles"] = [(r["sop_class"], r["scu"], r["scp"]) for r in user.get("roles") or ()]
    return encode_pdu(own)


def pdu_row(raw: bytes) -> dict:
    own = decode_pdu(raw)
    if user := own.get("user"):
        if "window" in user:
            user["window"] = dict(zip(("invoked", "performed"), user["window"], strict=True))
        user["roles"] = [dict(zip(("sop_class", "scu", "scp"), r, strict=True)) for r in user["roles"]]
    return own


def arrow_values(values: list, kind: pa.DataType) -> pa.Array:
    """pa.array of dictionaries or other values, column by column."""
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    whole = [{} if v is None else v for v in values]
    return pa.StructArray.from_arrays([pa.array([v.get(f.name) for v in whole], f.type) for f in kind], fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))


def _mapped(rows: DataFrame, column: str, out: str, kind: str, work) -> DataFrame:
    """rows with `column` replaced by `out`, what work makes of it, and a status: ok or the protocol's error."""
    keys = [c for c in rows.columns if c != column]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(out, T.StructType.fromDDL(f"x {kind}")["x"].dataType), T.StructField("status", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, statuses = [], []
            for value in python_values(batch.column(len(keys))):
                try:
                    results.append(work(value))
                    statuses.append("ok")
                except ProtocolError as e:
                    results.append(None)
                    statuses.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], arrow_values(results, arrow.field(out).type), pa.array(statuses, pa.string())], schema=arrow)

    return mapped(rows.select(*keys, column), run, schema)


def encode_pdus(rows: DataFrame, pdu: str = "pdu", payload: str = "payload") -> DataFrame:
    """rows with the bytes of a column of PDU structures (fields of PDU, those that its type has), and a status."""
    return _mapped(rows, pdu, payload, "binary", lambda v: pdu_bytes(v) if v else fail())


def decode_messages(log: DataFrame, payload: str = "payload", pdu: str = "pdu") -> DataFrame:
    """log with the structure PDU of its messages, all types, and a status."""
    return _mapped(log, payload, pdu, PDU, lambda v: pdu_row(v or b""))


def encode_commands(rows: DataFrame, command: str = "command", payload: str = "payload") -> DataFrame:
    """rows with the command set of a column of structures (fields of COMMAND), and a status."""
    return _mapped(rows, command, payload, "binary", lambda v: encode_command(given(v)) if v and v.get("command") in COMMAND_CODES else fail("unsupportedCommand"))


def decode_commands(log: DataFrame, payload: str = "payload", command: str = "command") -> DataFrame:
    """log with the structure COMMAND of its command sets, and a status."""
    return _mapped(log, payload, command, COMMAND, lambda v: decode_command(v or b""))


def retrieve_progress(commands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per C-MOVE or C-GET operation: keys, message_id, progress, final_status, category, and the final counters.

    commands has a struct `command` as decode_commands gives it. Progress lists the pending responses up to the final
    one, in order, with their four counters as they were sent; what follows the final response does not count. An
    operation without a final response has a NULL final_status.
    """
    own = commands.select(*keys, order, "command.*").where(F.col("command").isin("c_move_rsp", "c_get_rsp"))
    # One pass: a join of the responses with their final ones would decode the log twice.
    pending = status_category(F.col("status")) == "pending"
    final = F.when(~pending, F.col(order))
    found = own.groupBy(*keys, "responded_to").agg(F.min(final).alias("end"), F.min_by(F.struct("status", *COUNTS), final).alias("f"), F.array_sort(F.collect_list(F.when(pending, F.struct(order, *COUNTS)))).alias("all"))
    upto = F.filter("all", lambda x: F.col("end").isNull() | (x[order] <= F.col("end")))
    return found.select(*keys, F.col("responded_to").alias("message_id"), upto.alias("progress"), F.col("f.status").alias("final_status"), status_category(F.col("f.status")).alias("category"), *[F.col(f"f.{c}").alias(c) for c in COUNTS])


#: What a control PDU makes of an association's state; any other pair is a violation and aborts it.
MOVES = {("idle", "associate_rq"): "requested", ("requested", "associate_ac"): "established", ("requested", "associate_rj"): "rejected", ("established", "release_rq"): "releasing", ("releasing", "release_rq"): "releasing", ("releasing", "release_rp"): "released", ("released", "release_rp"): "released"}


def association_states(pdus: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per association of a log of PDUs: its last state, whether a PDU came out of turn, and its P-DATA inside.

    The states are idle, requested, established, rejected, releasing, released and aborted; releasing twice is as
    once. pdus has the keys, the order and type. Control PDUs are a handful an association and fold in order; P-DATA is
    only counted, by partial aggregates.
    """
    control = pdus.where("type <> 'p_data'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "type"))).alias("all"))
    moves = F.create_map(*[F.lit(x) for (a, b), c in MOVES.items() for x in (f"{a} {b}", c)])
    start = F.struct(F.lit("idle").alias("state"), F.lit(False).alias("violation"), F.lit(None).cast(pdus.schema[order].dataType).alias("opened"), F.lit(None).cast(pdus.schema[order].dataType).alias("closed"))

    def step(acc, x):
        done = acc["state"].isin("aborted", "rejected")
        to = F.when(x["type"] == "abort", F.lit("aborted")).otherwise(F.try_element_at(moves, F.concat_ws(" ", acc["state"], x["type"])))
        state = F.when(done, acc["state"]).otherwise(F.coalesce(to, F.lit("aborted")))
        opened = F.coalesce(acc["opened"], F.when(state == "established", x["at"]))
        closed = F.coalesce(acc["closed"], F.when((acc["state"] == "established") & (state != "established"), x["at"]))
        return F.struct(state.alias("state"), (acc["violation"] | to.isNull() | done).alias("violation"), opened.alias("opened"), closed.alias("closed"))

    states = control.select(*keys, F.aggregate("all", start, step).alias("s")).select(*keys, "s.*")
    data = pdus.where("type = 'p_data'").join(states, keys, "left")
    inside = (F.col(order) > F.col("opened")) & (F.col("closed").isNull() | (F.col(order) < F.col("closed")))
    counted = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_data"), F.sum((~F.coalesce(inside, F.lit(False))).cast("long")).alias("n_outside"))
    out = states.join(counted, keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, F.coalesce("state", F.lit("idle")).alias("state"), (F.coalesce("violation", F.lit(False)) | (zero(F.col("n_outside")) > 0)).alias("violation"), zero(F.col("n_data")).cast("long").alias("n_data"))


def answers(commands: DataFrame, store_status: Column | None = None) -> DataFrame:
    """commands' rows that are C-ECHO or C-STORE requests, with the struct `command` of the response to each.

    store_status is the status of each store, 0 unless given; other commands have no row.
    """
    asked = F.col("command.command")
    status = F.when(asked == "c_echo_rq", F.lit(0)).otherwise(F.lit(0) if store_status is None else store_status).cast("int")
    answer = F.struct(F.replace(asked, F.lit("_rq"), F.lit("_rsp")).alias("command"), F.col("command.message_id").alias("responded_to"), status.alias("status"), F.lit(False).alias("has_data_set"))
    return commands.where(asked.isin("c_echo_rq", "c_store_rq")).withColumn("command", answer)


def role_of(roles: Column, sop_class: Column) -> Column:
    """The first role (sop_class, scu, scp) of a SOP class in an array of them; NULL without one."""
    return F.get(F.filter(roles, lambda r: r["sop_class"] == sop_class), F.lit(0))


def fragmented(messages: DataFrame, content: str, maximum: int) -> DataFrame:
    """Messages cut to pieces that fit a PDU of `maximum` bytes: fragment, last, data. An empty message is one piece."""
    size = max(1, maximum - 12)
    n = F.greatest(F.ceil(F.length(content) / size), F.lit(1)).cast("int")
    cut = messages.withColumn("fragment", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select(*[c for c in messages.columns if c != content], "fragment", (F.col("fragment") == n - 1).alias("last"), F.expr(f"substring(`{content}`, fragment * {size} + 1, {size})").alias("data"))


def reassembled(fragments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Messages of fragments: (keys, message, complete, data). A message ends with its last fragment.

    Batch form: the number of ends before a fragment is its message; one message's pieces meet in one group.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = fragments.withColumn("message", F.coalesce(F.sum(F.col("last").cast("int")).over(before), F.lit(0)))
    place = F.struct(*order, F.hex("data").alias("hex")).alias("p")
    gathered = numbered.groupBy(*keys, "message").agg(F.max("last").alias("complete"), F.array_sort(F.collect_list(place)).alias("all"))
    return gathered.select(*keys, "message", "complete", F.unhex(F.array_join(F.col("all.hex"), "")).alias("data"))


def negotiated(requests: DataFrame, policy_titles: DataFrame | None, abstract_syntaxes: DataFrame, transfer_syntaxes: DataFrame, scp_roles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(associations, contexts, roles) of association requests under a policy.

    requests: assoc_id, application_context, called, contexts (array of id, abstract_syntax, transfer_syntaxes) and
    optionally roles (array of sop_class, scu, scp). The policy's tables are broadcast if they are small, as counted:
    policy_titles(title) or None for any, abstract_syntaxes(uid), transfer_syntaxes(uid, preference), scp_roles(uid).
    """
    checked = requests
    if policy_titles is None:
        checked = checked.withColumn("known", F.lit(True))
    else:
        titles = policy_titles.select(F.col("title").alias("called")).distinct().withColumn("known", F.lit(True))
        checked = checked.join(small(titles), "called", "left")
    reason = F.when(F.col("application_context") != APPLICATION_CONTEXT, 2).when(F.col("known").isNull(), 7)
    associations = checked.select("assoc_id", reason.isNull().alias("accepted"), reason.alias("reason"))
    fine = requests.join(associations.where("accepted").select("assoc_id"), "assoc_id", "left_semi")
    offers = fine.select("assoc_id", F.explode("contexts").alias("c")).select("assoc_id", "c.id", "c.abstract_syntax", "c.transfer_syntaxes")
    supported = abstract_syntaxes.select(F.col("uid").alias("abstract_syntax")).distinct().withColumn("supported", F.lit(True))
    each = offers.join(small(supported), "abstract_syntax", "left").select("*", F.explode_outer("transfer_syntaxes").alias("uid"))
    ranked = each.join(small(transfer_syntaxes.groupBy("uid").agg(F.min("preference").alias("preference"))), "uid", "left")
    chosen = ranked.groupBy("assoc_id", "id", "abstract_syntax").agg(F.max("supported").alias("supported"), F.min_by(F.when(F.col("preference").isNotNull(), F.col("uid")), "preference").alias("best"), F.first("transfer_syntaxes").alias("offered"))
    result = F.when(F.col("supported").isNull(), "abstract_syntax_not_supported").when(F.col("best").isNull(), "transfer_syntaxes_not_supported").otherwise("acceptance")
    contexts = chosen.withColumn("result", result).select("assoc_id", "id", "abstract_syntax", "result", F.when(F.col("result") == "acceptance", F.col("best")).otherwise(F.coalesce(F.get("offered", F.lit(0)), F.lit(""))).alias("transfer_syntax"))
    roles = None
    if "roles" in requests.columns:
        own = fine.select("assoc_id", F.posexplode("roles").alias("ordinal", "r")).select("assoc_id", "ordinal", "r.*")
        own = own.join(small(abstract_syntaxes.select(F.col("uid").alias("sop_class")).distinct()), "sop_class", "left_semi")
        may = (scp_roles if scp_roles is not None else abstract_syntaxes.limit(0)).select(F.col("uid").alias("sop_class")).distinct().withColumn("may", F.lit(True))
        roles = own.join(small(may), "sop_class", "left").select("assoc_id", "ordinal", "sop_class", "scu", (F.col("scp") & F.coalesce("may", F.lit(False))).alias("scp"))
    return associations, contexts, roles


def accepted_context(contexts: DataFrame) -> DataFrame:
    """The first accepted context of each association and SOP class."""
    return contexts.where("result = 'acceptance'").groupBy("assoc_id", "abstract_syntax").agg(F.min("id").alias("id"), F.min_by("transfer_syntax", "id").alias("transfer_syntax"))


def find_results(messages: DataFrame) -> DataFrame:
    """Pending identifiers of each find until its final status: (assoc_id, responded_to, identifiers, final_status).

    messages: assoc_id, responded_to, seq, status and identifier (NULL without one) of responses.
    """
    pending = status_category(F.col("status")) == "pending"
    return messages.groupBy("assoc_id", "responded_to").agg(
        F.transform(F.array_sort(F.collect_list(F.when(pending & F.col("identifier").isNotNull(), F.struct("seq", "identifier")))), lambda x: x["identifier"]).alias("identifiers"),
        F.min_by(F.when(~pending, F.col("status")), F.when(~pending, F.col("seq"))).alias("final_status"),
    )


def should_retry(status: Column) -> Column:
    """HTTP statuses worth another attempt."""
    return (status == 429) | status.between(500, 599)
