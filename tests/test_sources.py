import json

from cellscape.sources import io


def test_map_elements(spark, tmp_path):
    document = {"elements": [
        {"type": "node", "id": 1, "lat": 30.0, "lon": 79.0, "tags": {"name": "A"}},
        {"type": "node", "id": 4, "lat": 30.5, "lon": 79.5, "tags": {"amenity": "police"}},
        {"type": "way", "id": 2, "center": {"lat": 31.0, "lon": 78.0}, "tags": {"name:en": "B", "highway": "track"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}]},
        {"type": "node", "id": 3, "tags": {}},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(document))
    elements = io.read_map_elements(spark, str(tmp_path / "a.json"))
    assert {(r.osm_id, r.name, r.lat) for r in io.element_points(elements).collect()} == {("node/1", "A", 30.0), ("way/2", "B", 31.0), ("node/4", "Unnamed Emergency Police", 30.5)}
    assert [(r.highway, len(r.points)) for r in io.element_lines(elements).collect()] == [("track", 2)]


def test_cells_by_tile(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (5, 9, None)], "row int, col int, v double")
    io.write_cells(cells, str(tmp_path / "t"), 4)
    assert {r.tile for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"0_0", "1_2"}


def test_small_tiles_share_folders_and_are_refreshed_alone(spark, tmp_path):
    path = tmp_path / "t"
    cells = spark.range(40_000).selectExpr("cast(id div 100 as int) AS row", "cast(id % 100 as int) AS col", "cast(id as double) AS v").unionByName(spark.createDataFrame([(3000, 5, 1.0)], "row int, col int, v double"))
    io.write_cells(cells, str(path), 8)
    folders = lambda: {f: sorted(x.name for x in f.glob("*.parquet")) for f in path.glob("*=*")}
    before = folders()
    assert len(before) == 2
    io.refresh_cells(cells.where("row < 8 AND col < 8").selectExpr("row", "col", "-1.0D AS v"), str(path), 8)
    changed = [f.name for f in before if before[f] != folders()[f]]
    assert changed == ["block=0_0"] and len(folders()) == 2
    got = {(r.row, r.col): r.v for r in spark.read.parquet(str(path)).collect()}
    assert got == {(r.row, r.col): -1.0 if r.row < 8 and r.col < 8 else r.v for r in cells.collect()}


def test_settlements(spark, tmp_path):
    node = lambda i, x, y, **tags: {"type": "node", "id": i, "lat": y, "lon": x, "tags": tags}
    document = {"elements": [node(1, 0.0, 0.0), node(2, 1.0, 0.0), node(3, 1.0, 1.0), node(9, 5.0, 5.0, place="village", name="P"), {"type": "way", "id": 10, "nodes": [1, 2, 3, 1], "tags": {"name": "Q"}}, {"type": "way", "id": 11, "nodes": [1, 2, 77], "tags": {}}, {"type": "way", "id": 12, "nodes": [1], "tags": {}}]}
    (tmp_path / "a.json").write_text(json.dumps(document))
    got = {r.id: (r.kind, r.name, len(r.points)) for r in io.settlements(io.read_map_elements(spark, str(tmp_path / "a.json"))).collect()}
    assert got == {9: ("point", "P", 1), 10: ("polygon", "Q", 4), 11: ("line", None, 2)}


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "k int, v string")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_table(spark, str(tmp_path / "c"), "k int, v string").collect()), key=str) == [(1, "a, b"), (2, None)]
    io.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
