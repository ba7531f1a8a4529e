import json
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from webloom import config
from webloom.functions import text


@dataclass(frozen=True)
class Part:
    name: str
    share: float = 0.5


@dataclass(frozen=True)
class Whole:
    seed: int
    parts: tuple[Part, ...]
    limit: int | None = None
    names: dict[str, int] = field(default_factory=dict)


def test_settings_are_strict(tmp_path):
    good = {"seed": 3, "parts": [{"name": "a"}, {"name": "b", "share": 1}], "names": {"x": 1}}
    (tmp_path / "s.json").write_text(json.dumps(good))
    assert config.load(tmp_path / "s.json", Whole) == Whole(3, (Part("a"), Part("b", 1.0)), None, {"x": 1})
    for change, match in (({"sed": 1}, "unknown key sed"), ({"seed": "3"}, "seed"), ({"seed": True}, "seed"), ({"parts": [{"share": 1}]}, "no name"), ({"parts": 4}, "no list"), ({"limit": "x"}, "limit"), ({"names": {"x": "y"}}, "names.x")):
        with pytest.raises(TypeError, match=match):
            config.settings(good | change, Whole)
    with pytest.raises(TypeError, match="no seed"):
        config.settings({"parts": []}, Whole)


def test_emoji_become_names(spark):
    assert text.emoji_named("a 😀 b ⭐") == "a :grinning_face: b :white_medium_star:"
    df = spark.createDataFrame([("Sure 😀 thing\n\nThe Text",), ("Plain 🎉",), (None,)], "t string")
    assert [r[0] for r in df.select(text.cleaned_text(F.col("t"))).collect()] == ["the text", "plain :party_popper:", None]
