"""The scene graph of a known room: fixed values of its ten objects, and the relations between them."""

import json

from roomweave.operators import scene

# Fixed values.
OBJECTS = {
    "bed": {"centroid_3d": [-0.3710305752174201, 0.22850738234275275, 1.2381985730096436], "bbox_min": [-2.1433746814727783, -0.20883052051067352, 0.04192497953772545], "bbox_max": [1.2292723655700684, 0.7190572619438171, 2.4219589233398438], "volume_m3": 7.448169, "frames_seen": 35, "reconstruction_confidence": 0.4101, "provenance": "sparse"},
    "window": {"centroid_3d": [0.01564061349690574, 0.216987644090822, 0.24528649926736126], "bbox_min": [-1.7523409128189087, -0.5088961720466614, -1.109609603881836], "bbox_max": [1.2312902212142944, 0.8660441637039185, 2.5817108154296875], "volume_m3": 15.142958, "frames_seen": 21, "reconstruction_confidence": 0.2972, "provenance": "inferred"},
    "laptop": {"centroid_3d": [0.7320272061963701, 0.29820044685245106, 0.7916031867801255], "bbox_min": [0.09045151621103287, 0.023585844784975052, 0.16991493105888367], "bbox_max": [1.5398353338241577, 0.5462521910667419, 1.444301724433899], "volume_m3": 0.965404, "frames_seen": 26, "reconstruction_confidence": 0.4681, "provenance": "sparse"},
    "desk": {"centroid_3d": [-0.28303401860179617, 0.33854146142591945, 0.7931496513716839], "bbox_min": [-2.018369674682617, -0.10515041649341583, 0.09616818279027939], "bbox_max": [1.1113919019699097, 0.8626827001571655, 1.502381443977356], "volume_m3": 4.259542, "frames_seen": 44, "reconstruction_confidence": 0.425, "provenance": "sparse"},
    "shelf": {"centroid_3d": [-1.280791867706156, 0.21900849156370508, 0.4634929944036363], "bbox_min": [-2.0031447410583496, -0.3417055308818817, -0.8216894268989563], "bbox_max": [0.45770463347435, 0.8144813776016235, 1.5856318473815918], "volume_m3": 6.849315, "frames_seen": 13, "reconstruction_confidence": 0.2854, "provenance": "inferred"},
    "chair": {"centroid_3d": [0.5652445056382973, 0.45376406130761876, 0.782450875181898], "bbox_min": [0.032633375376462936, 0.07472497969865799, -0.04767456650733948], "bbox_max": [0.9693063497543335, 1.01706063747406, 1.6315534114837646], "volume_m3": 1.482188, "frames_seen": 28, "reconstruction_confidence": 0.4438, "provenance": "sparse"},
    "fan": {"centroid_3d": [0.7105901435634356, 0.2534460427159095, 0.9418694371072037], "bbox_min": [0.12246131896972656, -0.0023311476688832045, 0.49193626642227173], "bbox_max": [1.2265523672103882, 0.669748067855835, 1.499624490737915], "volume_m3": 0.747742, "frames_seen": 14, "reconstruction_confidence": 0.4859, "provenance": "sparse"},
    "door": {"centroid_3d": [-0.4761850706025453, 0.30644808577299637, 0.0074877929885551996], "bbox_min": [-2.0151150226593018, -0.7102439403533936, -1.117383360862732], "bbox_max": [0.9851548075675964, 1.2854678630828857, 1.5395106077194214], "volume_m3": 15.908615, "frames_seen": 21, "reconstruction_confidence": 0.2525, "provenance": "inferred"},
    "monitor": {"centroid_3d": [0.8240313339626336, 0.285551238963788, 0.616553331150162], "bbox_min": [0.626518964767456, 0.09137716889381409, 0.2077040821313858], "bbox_max": [1.0216320753097534, 0.46459928154945374, 0.9791257977485657], "volume_m3": 0.113758, "frames_seen": 10, "reconstruction_confidence": 0.5257, "provenance": "sparse"},
    "lamp": {"centroid_3d": [0.7161467129416776, 0.2506949707936293, 0.969577958104638], "bbox_min": [0.03823782503604889, 0.022607019171118736, 0.17336800694465637], "bbox_max": [1.2312902212142944, 0.6340863108634949, 1.6306920051574707], "volume_m3": 1.063157, "frames_seen": 11, "reconstruction_confidence": 0.471, "provenance": "sparse"},
}
NEXT_TO = [('bed', 'desk', 0.4669), ('chair', 'fan', 0.2945), ('chair', 'lamp', 0.3147), ('chair', 'laptop', 0.2283), ('chair', 'monitor', 0.3504), ('desk', 'window', 0.6356), ('door', 'window', 0.5535), ('fan', 'lamp', 0.0284), ('fan', 'laptop', 0.1583), ('fan', 'monitor', 0.346), ('lamp', 'laptop', 0.1849), ('lamp', 'monitor', 0.3708), ('laptop', 'monitor', 0.1981)]
NEAR_WALL = [('desk', 'window', 0.6356), ('door', 'door', 0.0), ('shelf', 'shelf', 0.0), ('window', 'window', 0.0)]
BETWEEN, BETWEEN_METRES = 74, 471924  # edges, and their distances in tenths of millimetres


def built(spark, folder, objects):
    (folder / "objects.json").write_text(json.dumps(objects))
    nodes = scene.make_nodes(scene.read_objects(spark, str(folder / "objects.json")))
    return nodes, scene.edges(scene.flat(nodes))


def test_graph(spark, tmp_path):
    nodes, links = built(spark, tmp_path, OBJECTS)
    assert [r.label for r in nodes.orderBy("ord").collect()] == list(OBJECTS)
    rows = links.collect()
    assert sorted((r.source, r.target, r.distance_m) for r in rows if r.relation == "next_to") == NEXT_TO
    assert sorted((r.source, r.nearest_wall_obj, r.distance_m) for r in rows if r.relation == "near_wall") == NEAR_WALL
    between = [r for r in rows if r.relation == "between"]
    assert len(between) == BETWEEN and sum(round(r.distance_m * 10_000) for r in between) == BETWEEN_METRES
    assert len(rows) == len(NEXT_TO) + len(NEAR_WALL) + BETWEEN
    room = scene.summary(nodes, 34.0).first()
    assert room.room_dimensions_m == [3.683, 1.996, 3.699] and (room.num_objects, room.num_sparse_objects, room.num_inferred_objects) == (10, 7, 3)
    document = json.loads(scene.document(nodes, links, scene.summary(nodes, 34.0)).first().document)
    assert [n["id"] for n in document["nodes"]] == list(OBJECTS) and len(document["edges"]) == len(rows) and document["room_summary"]["navigability_coverage_pct"] == 34.0
    assert all("target_1" not in e for e in document["edges"] if e["relation"] == "next_to")
    one = scene.where_is(nodes, links, "laptop").collect()
    assert len(one) == 1 and one[0].relations


def test_defaults(spark, tmp_path):
    """Lists, missing fields, labels in capitals; a wall at equal distance is the first."""
    objects = [{"label": "WALL", "centroid_3d": [0, 0, 0]}, {"label": "shelf", "centroid_3d": [1, 0, 0]}, {"centroid_3d": [0.5, 0, 0], "bbox_min": [0.4, 0, 0], "bbox_max": [0.6, 0, 0]}]
    nodes, links = built(spark, tmp_path, objects)
    rows = {r.label: r for r in nodes.collect()}
    assert rows["unknown"].provenance == "inferred" and rows["WALL"].bbox_min == [0.0, 0.0, 0.0] and rows["shelf"].frames_seen == 0
    assert {r.source: (r.target, r.nearest_wall_obj, r.distance_m) for r in links.collect() if r.relation == "near_wall"} == {"WALL": ("wall", "wall", 0.0), "shelf": ("wall", "shelf", 0.0), "unknown": ("wall", "WALL", 0.5)}
