"""An invented observatory: sites, telescopes, nights and what was seen. Models and rows of the end-to-end tests."""

import datetime as dt

TABLES = {
    "sites": ("id int, name string, region_code string", [(1, "Cold Ridge", "NR"), (2, "Salt Pan", "SP"), (3, "Moss Hill", None)]),
    "zones": ("id int, site_id int, title string, inside_id int", [(11, 1, "Summit", None), (12, 1, "Dome row", 11), (13, 1, "Annex", 11), (21, 2, "Flats", None)]),
    "telescopes": ("id int, site_id int, label string, built date, mirror int", [(51, 1, "Heron", dt.date(1998, 7, 4), 240), (52, 1, "Wren", dt.date(2011, 3, 9), 90), (61, 2, "Osprey", dt.date(2005, 12, 1), 400)]),
    "observers": ("id int, given string, family string", [(5, "Ilse", "Varga"), (6, "Tomo", "Arai"), (7, "Ada", "Quist"), (8, "Ned", "Bloom")]),
    "nights": ("id int, telescope_id int, observer_id int, day date, seeing int", [(301, 51, 5, dt.date(2020, 1, 5), 12), (302, 51, 6, dt.date(2020, 1, 6), 8), (303, 61, 5, dt.date(2021, 9, 9), 20), (304, 52, 7, None, 15)]),
    "targets": ("id int, catalogue string, sky string", [(71, "M", "Crab"), (72, "NGC", "Ring"), (73, "IC", "Veil")]),
    "pointings": ("night_id int, target_id int, minutes int, mode string", [(301, 72, 15, "snap"), (301, 71, 40, "deep"), (302, 72, 60, "deep"), (303, 73, 5, "snap"), (303, 71, 25, "snap")]),
    "reports": ("id int, night_id int, pages int, ok boolean", [(1, 301, 4, True), (2, 301, 9, False), (3, 302, 2, True)]),
    "surveys": ("id int, label string, follows_id int", [(1, "S-a", None), (2, "S-b", 1), (3, "S-c", 2), (4, "S-d", 3), (5, "S-e", 4)]),
    "notes": ("id int, about_id int, about_kind string", [(1, 6, "Observer"), (2, 61, "Telescope"), (3, 99, "Observer"), (4, 1, "Comet"), (5, None, None)]),
}


def f(source, type="string", **more):
    return {"source": source, "type": type, **more}


def rel(source, preset="item", **more):
    return {"source": source, "type": "preset", "preset": preset, **more}


def to(model, **more):
    return {"type": "belongs_to", "model": model, **more}


def many(model, **more):
    return {"type": "has_many", "model": model, **more}


def one(model, **more):
    return {"type": "has_one", "model": model, **more}


ID = f("id", "int")
MODELS = {
    "Site": {
        "table": "sites",
        "relations": {"zones": many("Zone", order="title ASC"), "telescopes": many("Telescope")},
        "presets": {
            "item": {"fields": [ID, f("name"), f("region_code")]},
            "shown": {"fields": [ID, f("name", alias="shown", formatter="{region_code}: {name}")]},
            "park": {"fields": [ID, rel("telescopes", formatter="{label}", alias="labels"), rel("zones", "tree")]},
        },
    },
    "Zone": {
        "table": "zones",
        "relations": {"site": to("Site"), "outer": to("Zone", fk="inside_id", reentrant=True, max_depth=6), "inner": many("Zone", fk="inside_id", reentrant=True, max_depth=6)},
        "presets": {"item": {"fields": [ID, f("title")]}, "up": {"fields": [ID, rel("outer")]}, "tree": {"fields": [f("title"), rel("inner", "leaf")]}, "leaf": {"fields": [f("title")]}},
    },
    "Telescope": {
        "table": "telescopes",
        "aggregatable": {"mirror": {"type": "int", "functions": ["sum", "avg", "min", "max"]}, "built": {"type": "date", "functions": "min, max"}},
        "relations": {"site": to("Site"), "nights": many("Night")},
        "presets": {"item": {"fields": [ID, f("site_id", "int"), f("label")]}, "sited": {"extends": "item", "fields": [rel("site", "shown"), f("{site.region_code}", "nested_field", alias="code")]}, "placed": {"extends": "item", "fields": [rel("site"), f("{site.region_code}", "nested_field", alias="code")]}},
    },
    "Observer": {
        "table": "observers",
        "aliases": {"heavens": "nights.targets"},
        "computable": {
            "signature": {"source": "(select concat({family}, ', ', {}.given))", "type": "string"},
            "n_nights": {"source": "(select count(*) from nights n where n.observer_id = main.id)", "type": "int"},
        },
        "relations": {
            "nights": many("Night"),
            "telescopes": many("Telescope", through="Night", order="label DESC"),
            "heron": one("Telescope", through="Night", where=".label = 'Heron'"),
            "sharp": one("Telescope", through="Night", through_where=".seeing < 10"),
        },
        "presets": {
            "item": {"fields": [ID, f("given", internal=True), f("family"), f("{given} {family}", "formatter", alias="full")]},
            "card": {"extends": "item", "fields": [f("id", "int", alias="observer_id"), f("given")]},
            "scopes": {"extends": "item", "fields": [rel("heron"), f("{full} @ {heron.label}", "formatter", alias="head")]},
            "computed": {"fields": [ID, f("signature", "computable"), f("n_nights", "computable")]},
            "all": {"fields": [ID, rel("telescopes"), rel("sharp", alias="best")]},
        },
    },
    "Night": {
        "table": "nights",
        "computable": {
            "read_pages": {"source": "coalesce(sum(case when {reports}.ok then {reports}.pages else 0 end), 0)", "type": "int"},
            "n_reports": {"source": "count({reports}.id)", "type": "int"},
        },
        "relations": {
            "telescope": to("Telescope"),
            "observer": to("Observer"),
            "targets": many("Target", through="Pointing", order=".sky ASC"),
            "deep": one("Target", through="Pointing", through_where=".mode = 'deep'"),
            "reports": many("Report"),
            "checked": one("Report", where=".ok = true", order="id DESC"),
        },
        "presets": {
            "item": {"fields": [ID, f("telescope_id", "int"), f("seeing", "int")]},
            "signed": {"extends": "item", "fields": [rel("observer"), f("{observer.full}", "formatter", alias="by")]},
            "sky": {"fields": [ID, rel("targets"), f("{id} - {targets[0].sky}", "formatter", alias="label")]},
            "deep": {"fields": [ID, rel("deep"), f("{id}/{deep.sky}", "formatter", alias="label")]},
            "pages": {"fields": [ID, f("read_pages", "computable"), f("n_reports", "computable")]},
            "head": {"fields": [ID, {"source": "checked", "formatter": "{pages} p.", "type": "preset", "preset": "item", "alias": "read"}]},
            "short": {"extends": "head"},
            "log": {"fields": [ID, rel("observer", "scopes", alias="who"), f("day", "date", alias="on", localize=True)]},
        },
    },
    "Target": {"table": "targets", "presets": {"item": {"fields": [ID, f("catalogue"), f("sky")]}}},
    "Pointing": {"table": "pointings", "primary_keys": ["night_id", "target_id"], "relations": {"night": to("Night"), "target": to("Target")}},
    "Report": {"table": "reports", "presets": {"item": {"fields": [ID, f("pages", "int")]}}},
    "Survey": {
        "table": "surveys",
        "relations": {"before": one("Survey", fk="id", pk="follows_id", reentrant=True, max_depth=3), "after": one("Survey", fk="follows_id", pk="id", reentrant=True, max_depth=3)},
        "presets": {"back": {"fields": [f("label"), rel("before", "back")]}, "on": {"fields": [f("label"), rel("after", "on")]}},
    },
    "Note": {"table": "notes", "relations": {"about": {"type": "belongs_to", "polymorphic": True, "type_column": "about_kind"}}, "presets": {"item": {"fields": [ID, rel("about")]}}},
}
