"""Readers of further datasets on small files of our own."""

import json

from pyspark.sql import functions as F

from spanloom.sources import datasets, files


def _write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def _touch(folder, *names):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(b"\xff\xd8\xff\xe0abc")
    return str(folder)


def test_robust_json_csv_and_text(spark, tmp_path):
    _write(tmp_path / "j" / "a.json", {"id": 1, "name": "x"})
    _write(tmp_path / "j" / "b.json", {"id": 2})
    _write(tmp_path / "j" / "c.json", "{broken")
    good, bad = files.json_rows(spark, str(tmp_path / "j"), "id int, name string", ["name"])
    assert [r.id for r in good.collect()] == [1] and sorted(map(tuple, bad.collect())) == [("b.json", "missing_name"), ("c.json", "invalid_json")]
    path = _write(tmp_path / "c.csv", "id,name\n1,a\nx,b\n3,\n")
    good, bad = files.csv_rows(spark, path, "id int, name string", ["name"])
    assert [r.id for r in good.collect()] == [1] and sorted(r.type for r in bad.collect()) == ["invalid_row", "missing_name"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "u.txt").write_bytes("é".encode())
    (tmp_path / "t" / "l.txt").write_bytes("é".encode("latin-1"))
    assert {r.file: r.text for r in files.text_rows(spark, str(tmp_path / "t")).collect()} == {"u.txt": "é", "l.txt": "é"}


def test_media_and_summary(spark, tmp_path):
    folder = _touch(tmp_path / "m", "a.jpg", "b.mp4", "e.txt")
    (tmp_path / "m" / "c.jpg").write_bytes(b"text")
    (tmp_path / "m" / "d.mp4").write_bytes(b"")
    rows = [("1", "a.jpg", "image"), ("2", "b.mp4", "video"), ("3", "c.jpg", "image"), ("4", "d.mp4", "video"), ("5", "no.jpg", "image"), ("6", "e.txt", "video")]
    good, bad = files.validated(spark.createDataFrame(rows, "sample_id string, media_path string, media_type string"), spark, folder)
    assert sorted(r.sample_id for r in good.collect()) == ["1", "2"]
    assert sorted(map(tuple, bad.collect())) == [("3", "corrupted_image"), ("4", "missing_file"), ("5", "missing_file"), ("6", "invalid_video_extension")]
    s = files.error_summary(spark.createDataFrame([("a", str(i)) for i in range(12)] + [("b", "x")], "type string, sample_id string"), "sample_id")
    assert {r.type: (r.n, len(r.first)) for r in s.collect()} == {"a": (12, 10), "b": (1, 1)}
    e = files.envelope(good, "d", F.col("sample_id"), F.col("media_path"), "image", "media_type", width=F.lit(3), height=F.lit(4)).first()
    assert (e.source_dataset, e.width, e.height, e.annotations.media_type) == ("d", 3, 4, "image")


def test_sa1b(spark, tmp_path):
    ann = lambda i, area, iou, bbox=(0, 0, 2, 4): {"id": i, "bbox": list(bbox), "area": area, "predicted_iou": iou, "stability_score": 0.97, "segmentation": {"size": [2, 2], "counts": "x" if i % 2 else ""}}
    _touch(tmp_path, "sa_1.jpg", "sa_2.jpg")
    _write(tmp_path / "sa_1.json", {"image": {"image_id": 1, "width": 9, "height": 8}, "annotations": [ann(1, 20.0, 0.95), ann(2, 5.0, 0.99), ann(3, 50.0, 0.99, (0, 0, 0, 3))]})
    _write(tmp_path / "sa_2.json", "{broken")
    _write(tmp_path / "sa_3.json", {"image": {"image_id": 3}, "annotations": [ann(1, 1.0, 1.0)]})
    rows = datasets.sa1b(spark, str(tmp_path), min_area=10).collect()
    assert [(r.sample_id, r.num_masks, r.total_area, r.avg_predicted_iou, r.annotations[0].center) for r in rows] == [("1", 1, 20.0, 0.95, [1.0, 2.0])]
    assert {r.sample_id: [a.id for a in r.annotations] for r in datasets.sa1b_stream(spark, str(tmp_path)).collect()} == {"sa1b_1": [1, 3], "sa1b_3": [1]}


def test_scene_text(spark, tmp_path):
    images = _touch(tmp_path / "i", "gt_1.jpg", "7.jpg")
    path = _write(tmp_path / "art.json", {"gt_1": [{"transcription": "hi", "points": [[0, 0]], "illegibility": False}, {"transcription": "##", "points": [], "illegibility": True}], "gt_2": []})
    rows = datasets.art(spark, path, images).collect()
    assert [(r.sample_id, [(t.text, t.language) for t in r.scene_text]) for r in rows] == [("gt_1", [("hi", "unknown")])]
    word = lambda t: {"Text": t, "Confidence": 9.0, "Geometry": {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.3, "Height": 0.4}}}
    _write(tmp_path / "ocr" / "a.json", {"LINE": [word("line")], "WORD": [word("word")]})
    _write(tmp_path / "ocr" / "b.json", {"words": [{"text": "w"}]})
    qa = _write(tmp_path / "q.json", {"data": [{"questionId": i, "question": "q", "answers": [], "image_local_name": n} for i, n in enumerate(("a.png", "b.png", "c.png"))]})
    got = {r.sample_id: [t.text for t in r.tokens] for r in datasets.infographics(spark, qa, str(tmp_path / "ocr")).collect()}
    assert got == {"0": ["line"], "1": ["w"], "2": []}
    c = _write(tmp_path / "c.json", {"data": [{"image_id": "7", "reference_strs": ["a b", "a b c"]}, {"image_id": "8", "reference_strs": []}]})
    o = _write(tmp_path / "o.json", {"data": [{"image_id": "7", "ocr_tokens": ["x", "y"], "ocr_info": [{"bounding_box": {"top_left_x": 1, "width": 2}}]}, {"image_id": "8"}]})
    (r,) = datasets.textcaps(spark, c, o, images).collect()
    assert (r.sample_id, r.avg_caption_words, r.tokens[0].bbox, r.tokens[1].bbox) == ("7", 2.5, [1.0, 0.0, 2.0, 0.0], None)


def test_captions_and_videos(spark, tmp_path):
    path = _write(tmp_path / "f.csv", 'raw,sentids,split,filename,img_id\n"[""a dog"", ""two""]","[1]",train,1.jpg,1\n"[""three""]","[2]",train,1.jpg,2\n"not a list","[3]",test,2.jpg,3\n')
    assert [(r.sample_id, r.captions, r.num_captions) for r in datasets.flickr(spark, path).collect()] == [("1.jpg", ["a dog", "two", "three"], 3)]
    videos = _touch(tmp_path / "v", "a.mp4", "b.mov")
    path = _write(tmp_path / "d.json", [{"annotation_id": "m", "video": "a.mp4", "description": "x", "times": [[0, 1], [2, 2]]}, {"video": "b.avi", "description": "y", "train_times": [[3, 3]]}, {"video": "c.mp4", "description": "z"}])
    got = {r.file: (r.moment, r.all_moments) for r in datasets.didemo(spark, path, videos).collect()}
    assert got == {"a.mp4": ([0.0, 10.0], [[0.0, 10.0], [10.0, 15.0]]), "b.mov": ([15.0, 20.0], [])}
    path = _write(tmp_path / "a.csv", "id,video,start_frame,end_frame,action_id,verb_id,noun_id,action_cls,verb_cls,noun_cls,toy_id,toy_name,is_shared,is_RGB\n4,a.mp4,10,12,1,2,3,pick,p,n,-,car,1,0\n5,zz.mp4,0,1,1,1,1,a,b,c,t,u,0,0\n")
    assert [(r.sample_id, r.duration_frames, r.toy_id, r.toy_name, r.is_shared) for r in datasets.assembly101(spark, path, videos).collect()] == [("segment_4", 3, None, "car", True)]
    k = _write(tmp_path / "k.csv", "video_id,keyframe_id\nv,3\nv,1\nw,2\n")
    assert {r.video_id: r.keyframes for r in datasets.star_keyframes(spark, k).collect()} == {"v": ["3", "1"], "w": ["2"]}
    s = _write(tmp_path / "s.csv", "video_id,start,end\nv,1,2\nv,3,4\n")
    assert [(r.video_id, r.start) for r in datasets.star_segments(spark, s).collect()] == [("v", 3.0)]


def test_epic(spark, tmp_path):
    for split, kind, name in (("train", "sparse", "P1"), ("train", "dense", "P1"), ("val", "sparse", "P2")):
        _write(tmp_path / "e" / split / kind / f"{name}.json", {"a": 1})
    got = {(r.sample_id, r.split): (r.sparse, r.dense, r.density) for r in datasets.epic(spark, str(tmp_path / "e")).collect()}
    assert got == {("P1", "train"): (True, True, 1.0), ("P2", "val"): (True, False, None)}
    classes = datasets.epic_classes(spark, _write(tmp_path / "c.csv", "id,name\n3,cup\nx,y\n"))
    frames = datasets.flat_map(spark, _write(tmp_path / "f.json", {"f1": "frame_0001"}))
    rows = spark.createDataFrame([(1, {"frame_ref": "f1", "class_id": "3", "other": "3"})], "k int, m map<string,string>")
    got = {r.field: (r.value, r.original) for r in datasets.translated(rows, F.col("m"), frames, classes, "k").collect()}
    assert got == {"frame_ref": ("frame_0001", "f1"), "class_id": ("cup", "3"), "other": ("3", "3")}


def test_uvo_parts_and_listings(spark, tmp_path):
    videos, masks = _touch(tmp_path / "v", "a_1.mp4", "f_2/0.png"), _touch(tmp_path / "m", "video7/x.png", "3-1.png", "1_1.png", "2-2.png", "bad.png")
    got = {r.video_id: r.dense is not None for r in datasets.uvo(spark, videos, dense=_touch(tmp_path / "dense", "a_1.json")).collect()}
    assert got == {"a_1": True, "f_2": False}
    assert {r.object_id: [f.frame for f in r.frames] for r in datasets.uvo_masks(spark, masks).collect()} == {1: [1, 3], 2: [2]}
    t = _write(tmp_path / "t.json", {"annotations": [{"object_id": 5, "image_id": 2}, {"id": 5, "frame_id": 1}, {"frame_id": 9}]})
    assert {r.object_id: [f.frame for f in r.frames] for r in datasets.uvo_tracks(spark, t).collect()} == {5: [1, 2], 0: [9]}
    df = spark.createDataFrame([("/d/video12/masks.json",), ("/d/masks/vid_3.json",), ("/d/123-4/x.png",)], "p string")
    assert [r[0] for r in df.select(datasets.video_id(F.col("p"))).collect()] == ["video12", "vid_3", "123-4"]
    pairs = datasets.part_pairs(spark, _touch(tmp_path / "pi", "n01_1.jpg", "n02_2.jpg"), _touch(tmp_path / "pm", "n01_1.png"))
    assert [(r.sample_id, r["class"]) for r in pairs.collect()] == [("n01_1", "n01")]
    side = tmp_path / "ua"
    _write(side / "n01_1.json", {"annotations": [{"box": [1, 2, 4, 8], "desc": "d"}, {"box": [1], "desc": "e"}]})
    rows = datasets.unsplash(spark, str(tmp_path / "pi"), str(side)).collect()
    assert [(r.sample_id, [x.bbox for x in r.regions]) for r in rows] == [("n01_1", [[1.0, 2.0, 3.0, 6.0]]), ("n02_2", [])]
    assert datasets.unsplash(spark, str(tmp_path / "pi"), str(side), annotated=True).count() == 1


def test_mot_sequences(spark, tmp_path):
    _touch(tmp_path / "s1" / "img1", "1.jpg", "2.jpg")
    _write(tmp_path / "s1" / "gt" / "gt.txt", "2,1,0,0\n5,1,0,0\n3,7,0,0\n")
    assert [tuple(r) for r in datasets.mot_sequences(spark, str(tmp_path)).collect()] == [("s1", 2, 5, 4, 2, 2)]


def test_generated_and_evaluated(spark, tmp_path):
    one = _write(tmp_path / "l.json", [{"sample_id": "a"}, {"sample_id": "b"}])
    two = _write(tmp_path / "o.json", {"samples": [{"sample_id": "c", "task_type": "t"}]})
    assert sorted(r.sample_id for p in (one, two) for r in datasets.cota(spark, p).collect()) == ["a", "b", "c"]
    f = _write(tmp_path / "f.jsonl", '{"case_id": "1", "success": false}\n{"case_id": "2"}\n{"case_id": "3", "success": true}\n')
    assert [r.case_id for r in datasets.failures(spark, f).collect()] == ["1"]
    folder = tmp_path / "an"
    _write(folder / "x.json", {"annotation_id": "x", "left_rating": 4})
    _write(folder / "session_1.jsonl", '{"annotation_id": "x", "left_rating": 4}\n{"annotation_id": "y"}\n')
    assert datasets.annotations(spark, str(folder)).count() == 2 and datasets.annotations(spark, str(folder), once=False).count() == 3
    _write(tmp_path / "r" / "exp" / "seed_1" / "evaluation_results.json", {"acc": 0.5, "iou": 0.1})
    _write(tmp_path / "r" / "exp" / "seed_1" / "final_metrics.json", {"acc": 0.9})
    assert {(r.experiment, r.seed, r.metric): r.value for r in datasets.experiment_results(spark, str(tmp_path / "r")).collect()} == {("exp", 1, "acc"): 0.9, ("exp", 1, "iou"): 0.1}
    reg = _write(tmp_path / "reg.json", {"e1": {"name": "n"}, "e2": {"name": "m"}})
    assert datasets.registry(spark, reg, "e2").first().name == "m"
    nodes, edges = datasets.lineage(spark, _write(tmp_path / "lin.json", {"nodes": {"a": {"name": "A"}, "b": {"name": "B"}}, "edges": {"a": ["b"]}}))
    assert sorted(r.node for r in nodes.collect()) == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("a", "b")]
    m = spark.createDataFrame([([1, 2, 1],), ([9],)], "c array<int>").select(datasets.rle_mask(F.col("c"), F.lit(2), F.lit(2)).alias("m"))
    assert [r.m for r in m.collect()] == [[0, 1, 1, 0], [0, 0, 0, 0]]
