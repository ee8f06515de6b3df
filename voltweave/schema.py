"""Table schemas."""

HOURS = [f"hour{i}" for i in range(1, 25)]
HOME_CSV = "hid long, longitude double, latitude double, " + ", ".join(f"{h} double" for h in HOURS)
HOMES = "hid long, lon double, lat double, profile array<double>, peak double, load double"
SUBSTATION_CSV = "ID string, X double, Y double"
ROAD_EDGE_CSV = "u long, v long, key int, geometry string, length double, highway string"
ROAD_NODE_CSV = "node_id long, x double, y double"
TRANSFORMER_CSV = "transformer_id string, longitude double, latitude double, total_load double"
SECONDARY_CSV = "from_node string, to_node string, length double, road_start long, road_end long, road_edge_key int"
NET_NODE_CSV = "node_id string, longitude double, latitude double, load double, label string"
NET_EDGE_CSV = "from_node string, to_node string, key int, highway string, length double, geometry string"
PRIM_NODE_CSV = "node_id string, cord string, label string, load double, distance double"
PRIM_EDGE_CSV = "source string, target string, geometry string, label string, length double"
PARTITION_JSON = (
    "map<string,struct<nodelist:map<string,struct<cord:array<double>,label:string,load:double,distance:double>>,"
    "edgelist:map<string,struct<highway:string,geometry:string,length:double>>>>"
)
