"""A service's row: every kind of neighbour, live ones only, bounded lists."""

from quarryline.operators import service_views as sv


def test_profiles(spark):
    nodes = [("s1", "Service", None), ("s2", "Service", None), ("s3", "Service", "gone"), ("t1", "Team", None), ("t2", "Team", "gone"), ("k1", "Ticket", None), ("k2", "Epic", None), ("p1", "Page", None), ("x", "Other", None), ("e", "Topic", None)]
    edges = [("s1", "OWNED_BY", "t1"), ("s1", "OWNED_BY", "t2"), ("s1", "OWNED_BY", "x"), ("s1", "DEPENDS_ON", "s2"), ("s2", "DEPENDS_ON", "s1"), ("s3", "DEPENDS_ON", "s1"), ("s1", "DEPENDS_ON", "s1"), ("k2", "LINKED_TO", "s1"), ("k1", "LINKED_TO", "s1"), ("k1", "LINKED_TO", "s1"), ("s1", "DOCUMENTED_IN", "p1"), ("s1", "PUBLISHES", "e"), ("s2", "SUBSCRIBES", "e"), ("s1", "MENTIONS", "p1"), ("s1", "DEPENDS_ON", None)]
    table = spark.createDataFrame([(i, label, i.upper(), gone) for i, label, gone in nodes], "source_id string, label string, name string, deleted_at string")
    links = spark.createDataFrame(edges, "source_id string, rel_type string, target_id string")
    got = {r.service: r for r in sv.service_profile(table, links, 1).collect()}
    assert set(got) == {"s1", "s2"}
    one = got["s1"]
    assert (one.owners, one.n_owners, one.name) == (["t1"], 1, "S1") and (one.uses, one.n_uses) == (["s1"], 2) and (one.used_by, one.n_used_by) == (["s1"], 2)
    assert (one.tickets, one.n_tickets) == (["k1"], 2) and one.documents == ["p1"] and one.published == ["e"] and one.subscribed == []
    assert got["s2"].subscribed == ["e"] and got["s2"].n_owners == 0
    assert sv.service_profile(table.where("false"), links).count() == 0 and sv.service_profile(table, links.where("false")).count() == 2
