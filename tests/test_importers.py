"""Models from tables, Prisma schemas and selections."""

import yaml

from presetlake.importers import naming, prisma, selection
from presetlake.importers.__main__ import main, write
from presetlake.importers.catalog import from_tables
from presetlake.spec.loader import Registry


def test_names():
    assert [naming.singular(x) for x in ("berries", "boxes", "glasses", "gardens", "people", "glass")] == ["berry", "box", "glass", "garden", "person", "glass"]
    assert naming.model_name("garden_beds") == "GardenBed"
    assert [naming.relation_name(x) for x in ("grower_id", "growerId", "mother", "id")] == ["grower", "grower", "mother", "id"]
    assert naming.name_column({"id": "int", "latin": "string", "title": "string", "short_name": "string"}, "id") == "short_name"
    assert naming.name_column({"id": "int"}, "id") is None and naming.id_column({"x": "int", "y": "int"}, ["x", "y"]) is None


def test_tables(spark):
    tables = {
        "growers": spark.createDataFrame([], "id int, name string, joined date"),
        "plants": spark.createDataFrame([], "plant_no bigint, name string, grower_id int, keeper_id int, height double, sown timestamp_ntz, hardy boolean"),
        "grafts": spark.createDataFrame([], "stock int, scion int"),
    }
    keys = {("plants", "grower_id"): ("growers", "id"), ("plants", "keeper_id"): ("growers", "id")}
    made = from_tables(tables, keys, {"plants": ["plant_no"], "grafts": ["stock", "scion"]})
    assert set(made) == {"Grower", "Plant"}  # nothing identifies a graft
    plant, grower = made["Plant"], made["Grower"]
    assert plant["presets"]["item"]["fields"][0] == {"source": "plant_no", "type": "int", "alias": "id"} and plant["primary_keys"] == ["plant_no"]
    assert [f["type"] for f in plant["presets"]["full_info"]["fields"]] == ["int", "string", "int", "int", "float", "datetime", "bool", "preset", "preset"]
    assert set(grower["relations"]) == {"plants", "plants_2"} and {"with_plants", "with_plants_2"} <= set(grower["presets"])
    assert set(Registry(made)) == {"Grower", "Plant"}
    assert set(from_tables(tables, dict([*keys.items()][:1]), only_simple=True)) == {"Grower"}


SCHEMA = """
enum Soil {
  CLAY
  SAND
  PEAT
}
model Bed {
  id     Int     @id @default(autoincrement())
  label  String? // on the sign
  soil   Soil    @default(SAND)
  plants Plant[]
  @@map("beds")
}
model Plant {
  id    Int    @id
  name  String
  bedId Int
  bed   Bed    @relation(fields: [bedId], references: [id])
  @@map("plants")
}
model Tool {
  toolKey String @id @db.Uuid
  name    String
}
"""


def test_prisma(tmp_path):
    models, words = prisma.read(SCHEMA)
    registry = Registry(models)
    bed, plant = registry["Bed"], registry["Plant"]
    assert (bed.table, bed.relations["plants"].fk, plant.relations["bed"].fk) == ("beds", "bedId", "bedId")
    assert "with_plants" in bed.presets and [f.key for f in plant.presets["full_info"].fields] == ["id", "name", "bedId", "bed"]
    assert next(f for f in bed.presets["full_info"].fields if f.source == "soil").localize and words == {"soil": {0: "CLAY", 1: "SAND", 2: "PEAT"}}
    assert models["Tool"]["presets"]["item"]["fields"][0] == {"source": "toolKey", "type": "UUID", "alias": "id"}
    path = tmp_path / "de.yml"
    path.write_text('soil:\n  "1": Sand\nweed:\n  "4": Quecke\n')
    prisma.merge_words(path, words)
    assert yaml.safe_load(path.read_text()) == {"soil": {"0": "CLAY", "1": "Sand", "2": "PEAT"}, "weed": {"4": "Quecke"}}


BASE = {
    "Bed": {"table": "beds", "relations": {"plants": {"type": "has_many", "model": "Plant", "fk": "bed_id"}}, "presets": {"item": {"fields": [{"source": "id", "type": "int"}, {"source": "label", "type": "string"}]}}},
    "Plant": {"table": "plants", "presets": {"item": {"fields": [{"source": "id", "type": "int"}, {"source": "name", "type": "string"}]}}},
}


def test_selections():
    chosen = [{"sign": "label"}, "id", {"plants": ["name", "id"]}]
    made, warnings = selection.add_presets(BASE, "bed", chosen, "BedSheet")
    assert warnings == [] and "BedSheet" not in str(BASE)
    fields = made["Bed"]["presets"][selection.preset_name("bed", "BedSheet", chosen)]["fields"]
    inner = selection.preset_name("plants", "BedSheet", ["name", "id"], ("plants",))
    assert fields[0] == {"source": "label", "alias": "sign", "type": "string"} and fields[2]["preset"] == inner
    assert inner in made["Plant"]["presets"] and Registry(made)
    assert len(selection.add_presets(BASE, "bed", ["id", {"birds": ["id"]}, "depth"])[1]) == 2 and selection.add_presets(BASE, "pond", ["id"])[1]
    held = {"Bed": BASE["Bed"] | {"presets": {selection.preset_name("bed", "", ["id"]): {"fields": []}}}}
    assert selection.add_presets(held, "bed", ["id"])[0]["Bed"] == held["Bed"]
    assert selection.add_presets(held, "bed", ["id"], replace=True)[0]["Bed"] != held["Bed"]


def test_files(tmp_path, capsys):
    (tmp_path / "schema.prisma").write_text(SCHEMA)
    main(["--prisma-schema", str(tmp_path / "schema.prisma"), "--out", str(tmp_path / "models"), "--locale", str(tmp_path / "de.yml")])
    assert set(Registry.load(tmp_path / "models")) == {"Bed", "Plant", "Tool"} and (tmp_path / "de.yml").exists()
    main(["--prisma-schema", str(tmp_path / "schema.prisma"), "--dry-run"])
    assert "with_plants" in capsys.readouterr().out
    assert write({}, tmp_path / "none") == []
