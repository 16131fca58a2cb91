"""Names and values that the two on-disk formats fix."""

# File names, keys of the JSON documents, separators, checksums.
V2_ARRAY, V2_GROUP, V2_ATTRS, V2_ALL = ".zarray", ".zgroup", ".zattrs", ".zmetadata"
V3_NODE = "zarr.json"
FORMAT_KEY = "zarr_format"
CONSOLIDATED_KEY = "zarr_consolidated_format"
METADATA_NAMES = (V2_ARRAY, V2_GROUP, V2_ATTRS, V2_ALL, V3_NODE)
V3_ARRAY_REQUIRED = (
    FORMAT_KEY, "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs",
)
V3_ARRAY_OPTIONAL = ("attributes", "storage_transformers", "dimension_names")
V3_GROUP_KEYS = (FORMAT_KEY, "node_type", "attributes", "consolidated_metadata")
EMPTY_INNER = (1 << 64) - 1
DEFAULT_FORMAT = 2
