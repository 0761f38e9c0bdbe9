"""The relations of document-object analytics, as DDL. Coordinates: PDF user space, origin bottom left, points."""

# Codes of object kinds, their labels and the prefixes of their sequential ids.
IMAGE, TEXT, SHAPE, DRAWING, SHADOW = range(5)
KIND_LABELS = ["Image", "Text", "Shape", "Drawing", "Shadow"]
KIND_PREFIXES = ["IMG", "TXT", "SHP", "DRW", "SHD"]

PLACEMENTS = "file_id string, page_number int, seq long, kind int, identity string, x double, y double, w double, h double, hides boolean, object_id string, resource_name string, is_safe boolean, unsafe_reason string"
PAGES = "file_id string, page_number int, width_pt double, height_pt double, rotate int"
IMAGES = "file_id string, object_id string, hash string, width int, height int, color_space string, bpc int, filter string, n_bytes long, is_mask boolean, smask_id string, is_shadow boolean"
REFERENCES = "file_id string, from_object string, to_object string"
REJECTS = "file_id string, error_kind string, message string"
