"""Colours of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, colour at rest, colour when pointed at.
PALETTE = [
    ("北京", "#BECBD3", "#8E9BAE"),
    ("天津", "#DCDDDF", "#B6BBBE"),
    ("河北", "#DDD0C8", "#A39183"),
    ("山西", "#EAE0D7", "#CFC3BC"),
    ("内蒙古", "#C6CCC0", "#8A9585"),
    ("辽宁", "#CCD2CC", "#737C75"),
    ("吉林", "#D6E1D7", "#A1B0AD"),
    ("黑龙江", "#BFD1C4", "#82ABA3"),
    ("上海", "#E3E7EA", "#9DA8AF"),
    ("江苏", "#DBD2C9", "#A39087"),
    ("浙江", "#E3D0CC", "#AB8C83"),
    ("安徽", "#F4EBE4", "#D2CABF"),
    ("福建", "#F2DBD5", "#CBA29E"),
    ("江西", "#EBC2C0", "#B87F78"),
    ("山东", "#D7CDD5", "#A392A2"),
    ("河南", "#E0DFE4", "#8D8FA4"),
    ("湖北", "#CFC3BC", "#A08887"),
    ("湖南", "#E6DEDC", "#C0B0A2"),
    ("广东", "#D6DCDB", "#82898D"),
    ("广西", "#C1CCC7", "#93A3A0"),
    ("海南", "#E6F1ED", "#A8B2AA"),
    ("重庆", "#D4C3AA", "#A39183"),
    ("四川", "#EDDFC4", "#B5AF5A"),
    ("贵州", "#D1D3C5", "#737C75"),
    ("云南", "#DEE1CB", "#93A3A0"),
    ("西藏", "#EEF1EA", "#ADB5AB"),
    ("陕西", "#C5BDB2", "#908982"),
    ("甘肃", "#D2CABF", "#A09952"),
    ("青海", "#EEDAC0", "#BFBC9D"),
    ("宁夏", "#D6D9B9", "#C0C182"),
    ("新疆", "#F3F4D5", "#CDDAA5"),
    ("香港", "#E8D8D7", "#B87F78"),
    ("澳门", "#F9ECE4", "#CBA29E"),
    ("台湾", "#E0DFE4", "#8D8FA4"),
]


def palette(spark: SparkSession, rows: list[tuple[str, str, str]] = PALETTE) -> DataFrame:
    return spark.createDataFrame(rows, "name string, normal string, hover string")


def region_style(regions: DataFrame, palette_: DataFrame) -> DataFrame:
    """Colour of each region; the same at rest and pointed at, so ``hover`` is not read."""
    return regions.join(palette_.select("name", palette_["normal"].alias("area_color")), "name")
