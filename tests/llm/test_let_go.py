"""What the similarity join keeps, and for how long."""

from weftgraph.llm import p1_near, p3_leaks, setjoin


def test_rows_do_not_stay_beside_sets(nodes, monkeypatch):
    given = []

    def long_sets(*args):
        given.append(found := made(*args))
        return found

    made = setjoin.long_sets
    table = nodes([(i, " ".join(f"w{k}" for k in range(i // 3, i // 3 + 25)), "t1" if i % 2 else "t2") for i in range(40)])
    splits = table.selectExpr("test_id", "if(test_id = 't1', 'train', 'test') AS split", "loaded_at AS assigned_at").distinct()
    for module, build in ((p1_near, lambda: p1_near.similar_pairs(table)), (p3_leaks, lambda: p3_leaks._links(table, splits, 3, 5, 20)[1])):
        monkeypatch.setattr(module, "long_sets", long_sets)
        pairs = build()
        rows, members, _ = given.pop()
        assert not rows.storageLevel.useDisk and not rows.storageLevel.useMemory
        assert members.storageLevel.useDisk
        assert pairs.count() > 0
