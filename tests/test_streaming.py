"""Changelogs: any cut into batches, in any order, gives what one batch gives."""

import datetime as dt
import itertools
import json

import pytest

from fathom.errors import PreconditionError, UnavailableError
from fathom.schema import Column, EntityType
from fathom.sources import tables as T
from fathom.sources.tables import folder_stream
from fathom.streaming import letters as L, outbox as O, projection as P

ITEM = EntityType("Item", "Id", (Column("Id"), Column("Name"), Column("Tenant")), tenant_field="Tenant")


def event(offset, op, key, name=None, type="Item", targets=1, payload=None, tenant="t"):
    body = payload if payload is not None else json.dumps({"Id": key, "Name": name, "Tenant": tenant})
    return (op, type, key, body, targets, offset, None)


EVENTS = [
    event(1, "created", "a", "1"), event(2, "created", "b", "1"), event(3, "updated", "a", "2"), event(4, "deleted", "b"), event(5, "created", "c", "x", payload="{no"),
    event(6, "created", "d", "1", targets=2), event(7, "created", "e", "1", type="Other"), event(8, "created", "f", "1", tenant=None), event(9, "deleted", "a"), event(10, "created", "a", "3"),
    event(11, "created", "g", "1"), event(12, "updated", "g", "2", tenant=None),
]
END = [("a", "3"), ("g", "1")]


def rows(df):
    return sorted((r.Id, r.Name) for r in df.collect())


def frame(spark, events):
    return spark.createDataFrame(events, P.EVENT_SCHEMA)


def test_merge_last_event_wins(spark):
    assert rows(P.merge(spark.createDataFrame([], ITEM.spark_schema()), frame(spark, EVENTS), ITEM)) == END
    assert [r.offset for r in P.split_events(frame(spark, EVENTS), ITEM)[1].collect()] == [5]


def test_all_orders_of_batches(spark):
    batches = [EVENTS[:3], EVENTS[3:6], EVENTS[6:9], EVENTS[9:]]
    deltas = [P.delta(frame(spark, b), ITEM) for b in batches]
    for order in itertools.permutations(range(4)):
        whole = deltas[order[0]]
        for k in order[1:]:
            whole = whole.unionByName(deltas[k])
        assert rows(P.living(whole, ITEM)) == END, order


def test_late_and_repeated_batches_with_folds(spark, tmp_path):
    own = P.Projection(spark, ITEM, str(tmp_path / "p"), fold_after=2)
    assert rows(own.read()) == [] and own.top_offset() == -1
    for batch in (EVENTS[8:], EVENTS[:4], EVENTS[8:], EVENTS[4:8], EVENTS[:4], EVENTS[:1]):
        own.apply(frame(spark, batch))
    assert rows(own.read()) == END and own.top_offset() == 11
    own.fold()
    own.fold()
    own.apply(frame(spark, [event(4, "created", "b", "late"), event(13, "created", "b", "new")]))
    own.apply(frame(spark, [event(9, "created", "a", "late")]))
    assert rows(own.read()) == [("a", "3"), ("b", "new"), ("g", "1")]
    base, folders = own.parts()
    assert base >= 0 and len(folders) <= 3


def test_a_late_event_does_not_bring_a_deleted_row_back(spark, tmp_path):
    own = P.Projection(spark, ITEM, str(tmp_path / "p"), fold_after=1)
    own.apply(frame(spark, [event(9, "deleted", "a")]))
    own.apply(frame(spark, [event(1, "created", "a", "1")]))
    own.apply(frame(spark, [event(2, "created", "b", "1")]))
    assert rows(own.read()) == [("b", "1")]


def test_stream_and_dead_letters(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, e in enumerate(EVENTS):
        (source / f"{k:03}.json").write_text(json.dumps(dict(zip(["op", "type", "key", "payload", "targets", "offset", "occurred_at"], e))))
    own = P.Projection(spark, ITEM, str(tmp_path / "p"))
    q = own.follow(folder_stream(spark, str(source), P.EVENT_SCHEMA, 4), str(tmp_path / "c"), str(tmp_path / "dead"))
    q.awaitTermination(120)
    assert rows(own.read()) == END
    dead = L.DeadLetters(spark, str(tmp_path / "dead"))
    assert [(r.offset, r.attempts) for r in dead.list().collect()] == [(5, 1)]
    sent = []

    def down(events):
        raise ConnectionError

    with pytest.raises(UnavailableError):
        dead.replay(down)
    assert tuple(dead.counts().first()) == (1, 0)
    assert dead.replay(lambda events: sent.extend(events.collect())) == 1 and [e.offset for e in sent] == [5]
    assert dead.list().collect() == [] and tuple(dead.counts().first()) == (0, 1) and dead.replay(down) == 0


def test_failing_batches_are_set_aside(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text(json.dumps(dict(zip(["op", "type", "key", "payload", "targets", "offset", "occurred_at"], EVENTS[0]))))
    calls = []

    def records():
        calls.append(1)
        raise ConnectionError("the record store is down")

    own = P.Projection(spark, ITEM, str(tmp_path / "p"), records=records)
    own.follow(folder_stream(spark, str(source), P.EVENT_SCHEMA), str(tmp_path / "c"), str(tmp_path / "dead"), wait=0).awaitTermination(120)
    row = L.DeadLetters(spark, str(tmp_path / "dead")).list().first()
    assert len(calls) == 3 and row.offset == 1 and row.attempts == 3 and "record store" in row.error and rows(own.read()) == []


def test_tenants_and_owners_come_from_the_records(spark):
    t = EntityType("Item", "Id", (Column("Id"), Column("Name"), Column("Tenant"), Column("Owner")), tenant_field="Tenant", owner_field="Owner")
    body = lambda k: json.dumps({"Id": k, "Name": "n", "Tenant": "forged", "Owner": "forged"})
    events = [("created", "Item", k, body(k), 1, i, None) for i, k in enumerate("abc")] + [("deleted", "Item", "z", None, 1, 9, None)]
    records = spark.createDataFrame([("a", "r", "t", "u"), ("b", "r", None, "u")], t.spark_schema())
    got = P.merge(spark.createDataFrame([("z", "n", "t", "u")], t.spark_schema()), frame(spark, events), t, records=records).collect()
    assert [tuple(r) for r in got] == [("a", "n", "t", "u")]


def test_enrichment_state_breaks_the_loop(spark):
    t = EntityType("N", "Id", (Column("Id"), Column("Text"), Column("Summary", enrichment="summary")))
    df = spark.createDataFrame([("1", "a", None), ("2", "b", None)], t.spark_schema())
    state = df.where("Id = '1'").select("Id", P.enrichment_hash(t)).toDF("key", "hash")
    assert [r.Id for r in P.to_enrich(df, t, state).collect()] == ["2"]
    written = df.withColumn("Summary", df["Text"])
    assert [r.Id for r in P.to_enrich(written, t, state).collect()] == ["2"]


@pytest.mark.parametrize("stored", [False, True])
def test_outbox(spark, tmp_path, stored):
    path = str(tmp_path / "log") if stored else None
    log = O.Log(spark, path)
    when = dt.datetime.now(dt.timezone.utc)
    assert log.append("created", "Item", [("a", "{}"), ("b", "{}")], 1, when) == 0 and log.append("deleted", "Item", [("a", "{}")], 1, when) == 2
    sent = []

    def down(events):
        raise ConnectionError("no broker")

    assert log.publish(down, attempts=2) == (0, 3) and tuple(log.counts().first()) == (3, 0, 0)
    assert log.publish(lambda e: sent.extend(e.collect()), size=2) == (2, 0) and [e.offset for e in sent] == [0, 1]
    assert log.publish(down, attempts=2) == (0, 1) and log.publish(down, attempts=2) == (0, 0)
    assert tuple(O.counts(log.events(), log.marks(), attempts=2).first()) == (0, 1, 2)
    if stored:
        again = O.Log(spark, path)
        assert again.append("created", "Item", [("c", "{}")], 1, when) == 3
        assert again.poll(lambda e: sent.extend(e.collect()), every=0, rounds=2) == 2 and [e.key for e in sent[2:]] == ["a", "c"]


def test_messages_and_events(spark):
    messages = T.encode_events(frame(spark, EVENTS[:2]), "00-trace-01")
    assert messages.columns == ["key", "value", "headers"] and bytes(messages.first().headers[0].value) == b"00-trace-01"
    raw = messages.selectExpr("CAST(key AS BINARY) key", "CAST(value AS BINARY) value", "0 partition", "CAST(7 + row_number() OVER (ORDER BY key) AS LONG) offset", "timestamp '2026-01-01' timestamp")
    raw = raw.unionAll(spark.createDataFrame([(bytearray(b"k"), bytearray(b"not json"), 0, 99, dt.datetime(2026, 1, 2))], raw.schema))
    events = T.decode_events(raw)
    good, bad = P.split_events(events, ITEM)
    assert [(r.op, r.key, r.offset, r.row.Name) for r in good.orderBy("offset").collect()] == [("created", "a", 8, "1"), ("created", "b", 9, "1")]
    assert [(r.offset, r.payload) for r in bad.collect()] == [(99, "not json")]


def test_reconcile_and_retries(spark):
    df = spark.createDataFrame([("1", "x", "t")], ITEM.spark_schema())
    events = P.reconcile(df, ITEM, above=41)
    assert events.first().offset == 41 and rows(P.merge(df.limit(0), events, ITEM)) == [("1", "x")]
    tries = []

    def fails_once():
        tries.append(1)
        if len(tries) < 2:
            raise PreconditionError

    P.with_retries(fails_once, wait=0)
    assert len(tries) == 2
