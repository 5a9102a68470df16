"""Protocol lines to protocol events for the three mail dialects.

A line is first tagged on its own. What depends on the dialogue (has the server greeted, is an upgrade still pending,
which credential does a prompt await, is a capability block open) is a state machine of a dozen states: each
line is a map from state to state, and one prefix scan (operators/scan.py) tells every line the state it is read in.
Two contexts are values, not states: the account name before a password and the tag of the last upgrade request. Only
the lines that need them are looked at again, by running maxima.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions.text import from_base64, is_mangled, secret_evidence
from postern.operators.ordered import running
from postern.operators.scan import packed, states_before
from postern.session import stage

FLOW = ["capture_id", "flow"]
FRAMES_PER_BLOCK = 1 << 15


def _starts(col: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col.startswith(p)
    return out


def tag_lines(lines: DataFrame) -> DataFrame:
    """Stateless facts of each line: upper text, direction flags and, for IMAP, tag, verb and rest."""
    parts = F.split(F.trim("text"), r"\s+", 3)
    return (
        lines.withColumn("up", F.upper("text"))
        .withColumn("from_server", F.col("dir") == "s2c")
        .withColumn("tag", F.upper(F.get(parts, F.lit(0))))
        .withColumn("verb", F.upper(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
        .withColumn("rest", F.coalesce(F.get(parts, F.lit(2)), F.lit("")))
    )


# States of a dialogue, as bits: greeted (1), upgrade pending (2), and above them what a prompt awaits (SMTP: nothing, a
# user name, a password) or whether a capability block is open (POP3); for IMAP the second bit is an unanswered AUTHENTICATE.
N_STATES = 12
_FIELDS = ["", "username", "password"]


def _step(move: Callable[[int, int, int], tuple[int, int, int]]) -> Column:
    """The map that moves (greeted, second bit, rest) of each state."""
    after = [move(s & 1, s >> 1 & 1, s >> 2) for s in range(N_STATES)]
    return F.lit(packed([g | p << 1 | r << 2 for g, p, r in after]))


def _steps(smtp: Column, imap: Column, pop: Column, s2c: Column) -> Column:
    up, ok = F.col("up"), F.col("up").startswith("+OK")
    stay = _step(lambda g, p, r: (g, p, r))
    off = _step(lambda g, p, r: (g, 0, r))
    greet = _step(lambda g, p, r: (1, p, r))
    prompt = F.trim(F.substr("text", F.lit(5))) == "VXNlcm5hbWU6"
    smtp_srv = (
        F.when(up.startswith("220"), F.when(F.contains(up, F.lit("TLS")), _step(lambda g, p, r: (1, p if not g else 0, r))).otherwise(greet))
        .when(_refused(), off)
        .when(up.startswith("334"), F.when(prompt, _step(lambda g, p, r: (g, p, 1))).otherwise(_step(lambda g, p, r: (g, p, 2))))
    )
    smtp_cli = (
        F.when(up.startswith("STARTTLS"), _step(lambda g, p, r: (g, 1, r)))
        .when(up.rlike(r"^AUTH +LOGIN\b"), _step(lambda g, p, r: (g, p, 1)))
        .when(_starts(up, "EHLO", "HELO", "AUTH "), stay)
        .otherwise(_step(lambda g, p, r: (g, p, 0)))
    )
    imap_srv = F.when(_imap_greets(), greet)
    # A client line right after an unanswered AUTHENTICATE is its credential; runs of them alternate.
    imap_cli = F.when(F.col("verb") == "AUTHENTICATE", _step(lambda g, p, r: (g, 1 - p, r))).otherwise(off)
    # A server line that resolves an upgrade neither opens nor closes a capability block.
    pop_srv = (
        F.when(up.startswith("+OK CAPA"), _step(lambda g, p, r: (1, p if not g else 0, r if not g or p else 1)))
        .when(ok, _step(lambda g, p, r: (1, p if not g else 0, r)))
        .when(F.trim("text") == ".", _step(lambda g, p, r: (g, 0, r if p else 0)))
        .otherwise(off)
    )
    pop_cli = F.when(up.startswith("STLS"), _step(lambda g, p, r: (g, 1, r))).when(up.startswith("CAPA"), _step(lambda g, p, r: (g, p, 1)))
    pick = lambda server, client: F.when(s2c, server).otherwise(client)
    return F.coalesce(F.when(smtp, pick(smtp_srv, smtp_cli)).when(imap, pick(imap_srv, imap_cli)).when(pop, pick(pop_srv, pop_cli)), stay)


def _refused() -> Column:
    return _starts(F.col("up"), "454", "502", "500", "421")


def _imap_greets() -> Column:
    return _starts(F.col("text"), "* OK", "* PREAUTH")


def with_context(lines: DataFrame) -> DataFrame:
    """Tagged lines plus the dialogue context each one is read in, by blocks of frames for every flow."""
    c = F.col
    order = ["frame", "side", "line_offset"]
    s2c, smtp, imap, pop = c("from_server"), c("protocol") == "SMTP", c("protocol") == "IMAP", c("protocol") == "POP3"
    blk = F.floor(c("frame") / FRAMES_PER_BLOCK)
    placed = lines.withColumn("side", F.when(c("dir") == "c2s", 0).otherwise(1))
    step = tag_lines(placed).withColumn("_step", _steps(smtp, imap, pop, s2c))
    read = states_before(step.select(*placed.columns, "_step"), FLOW, order, blk, c("_step"), 0, N_STATES).drop("_step")
    t = tag_lines(stage(read))

    greeted, second, third = c("state") % 2 == 1, F.floor(c("state") / 2) % 2 == 1, F.floor(c("state") / 4).cast("int")
    greets = s2c & ((smtp & c("up").startswith("220")) | (imap & _imap_greets()) | (pop & c("up").startswith("+OK")))
    t = t.withColumn("is_greeting", greets & ~greeted)
    pending = second & ~imap
    t = t.withColumns(
        {
            "k_accept": smtp & s2c & ~c("is_greeting") & c("up").startswith("220") & F.contains(c("up"), F.lit("TLS")),
            "k_refuse": smtp & s2c & _refused(),
            "upgrade_pending": pending,
            "last_prompt": F.struct(F.when(smtp, F.element_at(F.array(*[F.lit(x) for x in _FIELDS]), third + 1)).otherwise(F.lit("")).alias("field")),
            "pop_resolves": pop & s2c & ~c("is_greeting") & pending,
            "in_capa": pop & (third == 1),
            "sasl_line": imap & ~s2c & second,
        }
    )
    t = t.withColumn("imap_asks", imap & ~s2c & ~c("sasl_line") & (c("verb") == "STARTTLS"))
    names = pop & ~s2c & _starts(c("up"), "USER ", "PASS ")
    again = F.coalesce(names | c("imap_asks") | (imap & s2c), F.lit(False))
    user = F.struct(*order, F.trim(F.substr("text", F.lit(6))).alias("user"))
    look = running(
        t.where(again).withColumn("blk", blk), FLOW, order, "blk",
        {"last_user": ("max", F.when(names & c("up").startswith("USER "), user)), "last_tag": ("max", F.when(c("imap_asks"), F.struct(*order, "tag")))},
    ).drop("blk")
    answers = F.coalesce(imap & s2c & c("up").startswith(F.concat(c("last_tag.tag"), F.lit(" "))), F.lit(False))
    look = stage(look.withColumn("answers", answers))
    # only the first answer to an upgrade request counts
    here = F.struct(*order)
    first = look.where("answers").groupBy(*FLOW, "last_tag").agg(F.min(here).alias("_first"))
    look = look.join(first, [*FLOW, "last_tag"], "left").withColumn("tag_answers", c("answers") & (here == c("_first")))
    plain = t.where(~again).withColumns({"last_user": F.lit(None).cast(look.schema["last_user"].dataType), "tag_answers": F.lit(False)})
    wanted = [*lines.columns, *_CONTEXT]
    return plain.select(*wanted).unionByName(look.withColumn("tag_answers", F.coalesce("tag_answers", F.lit(False))).select(*wanted))


_CONTEXT = [
    "up",
    "from_server",
    "verb",
    "rest",
    "is_greeting",
    "k_accept",
    "k_refuse",
    "upgrade_pending",
    "last_prompt",
    "last_user",
    "pop_resolves",
    "in_capa",
    "sasl_line",
    "imap_asks",
    "tag_answers",
]


#: What an event says beside its line, typed; a field that does not belong to the kind is NULL.
META = ["banner", "identity", "keyword", "command", "mechanism", "mechanisms", "token", "reply_code", "status", "starttls", "login_disabled", "field"]
_CREDENTIAL = "struct<mechanism:string,username_redacted:string,credential_length:int,credential_sha256_prefix:string>"
_TYPES = {"mechanisms": "array<string>", "starttls": "boolean", "login_disabled": "boolean"}


class Rule(NamedTuple):
    """Where a line makes an event, and what the event says."""

    cond: Column
    kind: str | Column
    detail: Column | None
    credential: Column | None
    meta: dict[str, Column | str]


def _event(cond: Column, kind: str | Column, detail: Column | None = None, credential: Column | None = None, **meta: Column | str) -> Rule:
    return Rule(cond, kind, detail, credential, meta)


def _by_rule(values: dict[int, Column | str], kind: str, other: Column | None = None) -> Column:
    """The value that the rule `_rule` gives, where it gives one."""
    out: Column | None = None
    for rule, value in values.items():
        own = F.lit(value) if isinstance(value, str) else value
        out = F.when(F.col("_rule") == rule, own) if out is None else out.when(F.col("_rule") == rule, own)
    if out is None:
        return F.lit(None).cast(kind)
    return (out if other is None else out.otherwise(other)).cast(kind)


def events(lines: DataFrame) -> DataFrame:
    """Protocol events of a dialogue: one row per event with kind, position, time, detail, redacted credential and metadata.

    `ts` is the time of the line's first byte, where the lines have one.
    """
    c = F.col
    t = with_context(lines)
    s2c, c2s = c("from_server"), ~c("from_server")
    smtp, imap, pop = c("protocol") == "SMTP", c("protocol") == "IMAP", c("protocol") == "POP3"
    up, greeting = c("up"), c("is_greeting")
    # one list per dialect and side: a row only evaluates the rules of its own
    smtp_srv: list[Rule] = []
    smtp_cli: list[Rule] = []
    imap_srv: list[Rule] = []
    imap_cli: list[Rule] = []
    pop_srv: list[Rule] = []
    pop_cli: list[Rule] = []
    banner = F.when(pop, F.trim(F.substr("text", F.lit(4)))).otherwise(F.trim(F.substr("text", F.lit(5))))
    for rules in (smtp_srv, imap_srv, pop_srv):
        rules.append(_event(greeting, "greeting", banner, banner=banner))
    # --- SMTP, server side
    srv = smtp & s2c & ~greeting
    offers = up.rlike(r"^250[- ]STARTTLS\s*$")
    token = F.substr("text", F.lit(5))
    mangled = up.rlike("^250[- ]") & is_mangled(token)
    auth_cap = up.rlike(r"^250[- ]AUTH\s+.+$")
    smtp_srv.append(_event(srv & offers, "upgrade_advertised", keyword="STARTTLS"))
    smtp_srv.append(_event(srv & ~offers & mangled, "upgrade_advertised_mangled", F.trim(token), token=F.trim(token)))
    smtp_srv.append(_event(srv & ~offers & ~mangled & auth_cap, "capability_response", mechanisms=F.split(F.trim(F.regexp_extract("text", r"(?i)^250[- ]AUTH\s+(.+)$", 1)), r"\s+")))
    rest = srv & ~offers & ~mangled & ~auth_cap
    smtp_srv.append(_event(rest & c("k_accept"), "upgrade_accepted"))
    smtp_srv.append(_event(rest & c("k_refuse") & c("upgrade_pending"), "upgrade_rejected", reply_code=F.substr("text", F.lit(1), F.lit(3))))
    smtp_srv.append(_event(rest & up.startswith("235"), "auth_succeeded"))
    smtp_srv.append(_event(rest & up.startswith("535"), "auth_failed"))
    # --- SMTP, client side
    cli = smtp & c2s
    hello, starts, auth = _starts(up, "EHLO", "HELO"), up.startswith("STARTTLS"), up.startswith("AUTH ")
    words = F.split(F.trim("text"), r"\s+")
    mechanism = F.upper(F.coalesce(F.get(words, F.lit(1)), F.lit("UNKNOWN")))
    plain = from_base64(F.get(words, F.lit(2)))
    plain_parts = F.split(plain, "\u0000")
    smtp_cli.append(_event(cli & hello, "capability_request", F.trim(F.substr("text", F.lit(6))), identity=F.trim(F.substr("text", F.lit(6)))))
    smtp_cli.append(_event(cli & ~hello & starts, "upgrade_requested", command="STARTTLS"))
    smtp_cli.append(_event(cli & ~hello & ~starts & auth, "auth_requested", F.concat(F.lit("AUTH "), mechanism), mechanism=mechanism))
    smtp_cli.append(
        _event(
            cli & ~hello & ~starts & auth & (mechanism == "PLAIN") & (F.size(words) > 2),
            "auth_credential",
            F.lit("AUTH PLAIN credential"),
            secret_evidence(F.lit("AUTH PLAIN"), F.get(plain_parts, F.lit(1)), F.get(plain_parts, F.lit(2))),
        )
    )
    other = cli & ~hello & ~starts & ~auth
    field = F.coalesce(c("last_prompt.field"), F.lit(""))
    decoded = from_base64(F.trim("text"))
    is_user = field == "username"
    smtp_cli.append(
        _event(
            other & (field != ""),
            "auth_credential",
            F.concat(F.lit("AUTH LOGIN "), field),
            secret_evidence(F.lit("AUTH LOGIN"), F.when(is_user, decoded), decoded),
            field=field,
        )
    )
    idle = other & (field == "")
    smtp_cli.append(_event(idle & _starts(up, "MAIL FROM", "RCPT TO", "DATA"), "mail_transaction", F.trim(F.substring_index("text", ":", 1))))
    smtp_cli.append(_event(idle & up.startswith("QUIT"), "session_end", F.lit("QUIT")))
    # --- IMAP
    caps = imap & s2c & (up.startswith("* CAPABILITY") | F.contains(up, F.lit("[CAPABILITY")))
    imap_srv.append(_event(caps, "capability_response", starttls=up.rlike(r"\bSTARTTLS\b"), login_disabled=up.rlike(r"\bLOGINDISABLED\b")))
    imap_srv.append(_event(caps & up.rlike(r"\bSTARTTLS\b"), "upgrade_advertised", keyword="STARTTLS"))
    status = F.get(F.split(F.trim("text"), r"\s+"), F.lit(1))
    verdict = F.when(F.upper(status) == "OK", F.lit("upgrade_accepted")).otherwise(F.lit("upgrade_rejected"))
    imap_srv.append(_event(c("tag_answers"), verdict, status=F.upper(status)))
    icl = imap & c2s
    imap_cli.append(
        _event(icl & c("sasl_line"), "auth_credential", F.lit("IMAP AUTHENTICATE credential"), secret_evidence(F.lit("IMAP AUTHENTICATE"), decoded, decoded))
    )
    live = icl & ~c("sasl_line")
    verb = c("verb")
    imap_cli.append(_event(live & (verb == "CAPABILITY"), "capability_request"))
    imap_cli.append(_event(c("imap_asks"), "upgrade_requested", command="STARTTLS"))
    imap_cli.append(_event(live & (verb == "LOGIN"), "auth_requested", F.lit("LOGIN"), mechanism="LOGIN"))
    login = r'(?i)^\S+\s+LOGIN\s+(?:"([^"]*)"|(\S+))\s+(?:"([^"]*)"|(\S+))\s*$'
    group = lambda i: F.regexp_extract("text", login, i)
    user = F.when(group(1) != "", group(1)).otherwise(group(2))
    password = F.when(group(3) != "", group(3)).otherwise(group(4))
    imap_cli.append(
        _event(live & (verb == "LOGIN") & (password != ""), "auth_credential", F.lit("IMAP LOGIN credential"), secret_evidence(F.lit("IMAP LOGIN"), user, password))
    )
    imap_mech = F.upper(F.coalesce(F.get(F.split("rest", r"\s+"), F.lit(0)), F.lit("UNKNOWN")))
    imap_cli.append(_event(live & (verb == "AUTHENTICATE"), "auth_requested", F.concat(F.lit("AUTHENTICATE "), imap_mech), mechanism=imap_mech))
    imap_cli.append(_event(live & verb.isin("SELECT", "EXAMINE", "FETCH", "LIST"), "mailbox_access", verb))
    imap_cli.append(_event(live & (verb == "LOGOUT"), "session_end", F.lit("LOGOUT")))
    # --- POP3
    pop_srv.append(_event(c("pop_resolves"), F.when(up.startswith("+OK"), F.lit("upgrade_accepted")).otherwise(F.lit("upgrade_rejected"))))
    listing = pop & s2c & ~greeting & ~c("pop_resolves") & c("in_capa")
    pop_srv.append(_event(listing & (F.trim("up") == "STLS"), "upgrade_advertised", keyword="STLS"))
    pcl = pop & c2s
    capa, stls = up.startswith("CAPA"), up.startswith("STLS")
    pop_cli.append(_event(pcl & capa, "capability_request"))
    pop_cli.append(_event(pcl & ~capa & stls, "upgrade_requested", command="STLS"))
    pop_cli.append(_event(pcl & up.startswith("USER "), "auth_requested", F.lit("USER"), mechanism="USER/PASS"))
    pw = F.trim(F.substr("text", F.lit(6)))
    pop_cli.append(_event(pcl & up.startswith("PASS "), "auth_credential", F.lit("POP3 PASS credential"), secret_evidence(F.lit("POP3 USER/PASS"), c("last_user.user"), pw)))
    pop_cli.append(_event(pcl & _starts(up, "STAT", "LIST", "RETR", "UIDL", "TOP "), "mailbox_access", F.get(words, F.lit(0))))
    pop_cli.append(_event(pcl & up.startswith("QUIT"), "session_end", F.lit("QUIT")))
    branches = [(smtp, smtp_srv, smtp_cli), (imap, imap_srv, imap_cli), (pop, pop_srv, pop_cli)]
    # A line first names its rules, as numbers; what an event says is worked out for the events alone, and only where it is read.
    every: list[Rule] = []
    found = None
    for dialect, server_rules, client_rules in branches:
        for cond, rules in ((dialect & s2c, server_rules), (dialect & c2s, client_rules)):
            hits = F.array(*[F.when(r.cond, F.lit(len(every) + i)) for i, r in enumerate(rules)])
            found = F.when(cond, hits) if found is None else found.when(cond, hits)
            every += rules
    most = max(len(r) for _, *sides in branches for r in sides)
    t = t.withColumn("_rules", found)
    t = t.select(*t.columns, F.posexplode("_rules").alias("_at", "_rule")).where(F.col("_rule").isNotNull())
    earlier = [F.when((F.lit(i) < F.col("_at")) & F.get("_rules", F.lit(i)).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for i in range(most - 1)]
    at = [*FLOW, "protocol", "dir", "frame", "line_offset", *(["ts"] if "ts" in lines.columns else [])]
    numbered = list(enumerate(every))
    return t.select(
        *at,
        reduce(add, earlier).alias("event_no"),
        _by_rule({i: r.kind for i, r in numbered}, "string").alias("kind"),
        _by_rule({i: r.detail for i, r in numbered if r.detail is not None}, "string", c("text")).alias("detail"),
        _by_rule({i: r.credential for i, r in numbered if r.credential is not None}, _CREDENTIAL).alias("credential"),
        F.struct(*[_by_rule({i: r.meta[m] for i, r in numbered if m in r.meta}, _TYPES.get(m, "string")).alias(m) for m in META]).alias("meta"),
    )


def first_greeting(evts: DataFrame) -> DataFrame:
    return evts.where(F.col("kind") == "greeting").groupBy(*FLOW).agg(F.min_by("detail", "frame").alias("server_banner"))
