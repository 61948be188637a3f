"""Tables of a database, by the driver that Spark brings along."""

import uuid

import pytest
import yaml

from presetlake.engine import Engine
from presetlake.importers.__main__ import main
from presetlake.sources.catalog import Catalog
from presetlake.spec.loader import Registry

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def url(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    for name, rows, schema in (("mills", [(1, "North"), (2, "South")], "id int, name string"), ("wheels", [(i, 1 + i % 2, float(i)) for i in range(1, 9)], "id int, mill_id int, width double")):
        spark.createDataFrame(rows, schema).write.format("jdbc").options(url=url, dbtable=name, driver=DRIVER).save()
    return url


def test_a_database_is_read_in_ranges_and_queried(spark, url):
    lower = lambda df: df.toDF(*map(str.lower, df.columns))
    read = Catalog(spark).jdbc("wheels", url, column="ID", partitions=4, bounds=(1, 9), driver=DRIVER).table("wheels")
    assert read.rdd.getNumPartitions() == 4 and read.count() == 8
    catalog = Catalog(spark, tables={"wheels": lower(read), "mills": lower(Catalog(spark).jdbc("mills", url, driver=DRIVER).table("mills"))})
    models = {
        "Mill": {"table": "mills", "relations": {"wheels": {"type": "has_many", "model": "Wheel"}}, "presets": {"item": {"fields": [{"source": "name", "type": "string"}]}}},
        "Wheel": {"table": "wheels", "relations": {"mill": {"type": "belongs_to", "model": "Mill"}}, "presets": {"item": {"fields": [{"source": "id", "type": "int"}, {"source": "mill", "type": "preset", "preset": "item"}]}}},
    }
    engine = Engine(Registry(models), catalog)
    rows = engine.index({"model": "Wheel", "preset": "item", "filters": {"mill.name": "south", "width__gt": 4}, "sorts": ["id"]}).collect()
    assert [(r.id, r.mill.name) for r in rows] == [(5, "South"), (7, "South")]
    plan = engine.index({"model": "Wheel", "preset": "item", "filters": {"width__gt": 4}})._jdf.queryExecution().executedPlan().toString()
    assert "greaterthan(width,4.0)" in plan.lower()


def test_models_of_a_database_with_presets_of_selections(url, tmp_path, capsys):
    (tmp_path / "keys.yml").write_text("primary: {mills: [id], wheels: [id]}\nforeign: {wheels.mill_id: mills.id}\n")
    (tmp_path / "ask.yml").write_text(yaml.safe_dump([{"root": "wheel", "operation": "Sheet", "fields": ["id", {"mill": ["name"]}, "colour"]}]))
    main(["--jdbc-url", url, "--jdbc-tables", "mills, wheels", "--jdbc-driver", DRIVER, "--keys", str(tmp_path / "keys.yml"), "--selections", str(tmp_path / "ask.yml"), "--replace-presets", "--out", str(tmp_path / "models")])
    made = Registry.load(tmp_path / "models")
    assert set(made) == {"Mill", "Wheel"} and sum("Sheet" in p for m in made.values() for p in m.presets) == 2
    assert "Wheel.colour: taken for a string" in capsys.readouterr().out
