import json

from pyspark.sql import types as T

from loomline.operators import nesting as N

MEDIA = (
    "struct<provider: string, oembed: struct<title: string, thumbnails: array<struct<url: string, width: int>>>, hosted_video: struct<renditions: array<struct<url: string, "
    "tracks: array<struct<lang: string, purpose: string>>>>>, gallery: array<struct<media_id: string, variants: array<struct<url: string>>>>>"
)


def rows(df):
    return sorted((r["key"], r["kind"], r["parent_pos"], r["pos"]) for r in df.collect())


def test_structs_with_holes(spark):
    media = {
        "oembed": {"thumbnails": [{"url": "a", "width": 1}, None, {"url": None, "width": None}]},
        "hosted_video": {"renditions": [None, {"url": "r", "tracks": [{"lang": "en"}, None, {"lang": "de"}]}, {"url": "s", "tracks": None}, {"url": "t", "tracks": []}]},
        "gallery": [{"media_id": "m", "variants": [{"url": "v"}]}, None, {"media_id": "n", "variants": [None, {"url": "w"}]}],
    }
    data = [(1, media, 9, 9), (2, None, 9, 9), (3, {"provider": "p"}, 9, 9), (4, {"gallery": []}, 9, 9), (4, {"gallery": [{}]}, 9, 9)]
    df = spark.createDataFrame(data, f"line_no long, media {MEDIA}, key int, pos int")
    want = [(1, "thumbnail", -1, 0), (1, "thumbnail", -1, 2), (1, "rendition", -1, 1), (1, "rendition", -1, 2), (1, "rendition", -1, 3), (1, "track", 1, 0), (1, "track", 1, 2)]
    want += [(1, "gallery_item", -1, 0), (1, "gallery_item", -1, 2), (1, "variant", 0, 0), (1, "variant", 2, 1), (4, "gallery_item", -1, 0)]
    objects = N.flatten_nested(df, "line_no", "media", N.MEDIA)
    assert rows(objects) == sorted(want)
    tracks = N.flat_table(objects, "track", {"lang": "string"}).orderBy("pos").collect()
    assert [(r["parent_pos"], r["lang"]) for r in tracks] == [(1, "en"), (1, "de")]
    assert rows(N.flatten_nested(df.limit(0), "line_no", "media", N.MEDIA)) == []
    assert rows(N.flatten_nested(df.coalesce(1), "line_no", "media", N.MEDIA)) == sorted(want)


def test_columns_that_are_absent_from_the_schema(spark):
    df = spark.createDataFrame([(1, {"provider": "x"})], "line_no long, media struct<provider: string>")
    assert rows(N.flatten_nested(df, "line_no", "media", N.MEDIA)) == []


def test_json_texts(spark):
    whole = {"sources": [{"src": "a", "sizes": {"w": 1}}, None, {"src": "b", "sizes": [{"w": 1}, None, {}]}]}
    texts = [
        json.dumps(whole),
        json.dumps(json.dumps(whole)),
        json.dumps(whole)[:-1],
        json.dumps(whole) + " x",
        '{"sources": {"src": "lone"}}',
        '{"sources": "text"}',
        "null",
        "[]",
        "",
        None,
        "{" * 5000,
        "12",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, e string")
    one = [("source", -1, 0), ("source", -1, 2), ("size", 0, 0), ("size", 2, 0), ("size", 2, 2)]
    want = [(i, *x) for i in (0, 1) for x in one] + [(4, "source", -1, 0)]
    assert rows(N.flatten_json(df, "line_no", "e", N.EMBED)) == sorted(want)


def test_schema_of_result(spark):
    df = spark.createDataFrame([(1, None, None)], f"line_no long, media {MEDIA}, secure_media_embed string")
    assert N.post_objects(df).schema["pos"].dataType == T.IntegerType()
