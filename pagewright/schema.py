"""Column layouts of the relations; all nested trees are kept as keyed rows."""

FILES = "path string, name string, size long, modified_time timestamp, is_dir boolean"
PAGES = "path string, page_number int, text string"
BOX = ("llx", "lly", "urx", "ury", "width", "height")
ELEMENTS = (
    "path", "element_id", "parent_id", "level", "type", "page_number", "line_idx", "word_idx",
    *BOX, "text", "font_size", "detail", "confidence",
)
IMAGE = "struct<name:string,width:int,height:int,filter:string,color_space:string,bits:int,data:binary>"
ANNOTATION = "struct<subtype:string,contents:string,rect:array<double>>"
PARSED = (
    "path string, size long, page_number int, n_pages int, text string, media_box array<double>, own_media_box boolean, "
    f"crop_box array<double>, rotation int, images array<{IMAGE}>, annotations array<{ANNOTATION}>, "
    "info map<string,string>, version string, encrypted boolean, error string"
)
