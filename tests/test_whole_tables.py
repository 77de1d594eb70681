"""Queries read whole tables."""

from corpuslens import queries


def test_json_links_takes_every_event(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "event_type", "user_id").collect()
    want = {(e.event_id, "x" if e.event_type == "pmc" else str(e.user_id), None) for e in events}
    got = [tuple(r) for r in queries.json_links(spark, small).collect()]
    assert len(got) == len(events) and set(got) == want and any(i % 10 for i, _, _ in got)
