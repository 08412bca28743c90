"""Enumerations and defaults of the domain."""

# Classes of the detector by number, and Arabic names shown for codes.
DETECTION_CLASSES = {0: "vehicle", 1: "motorcycle", 2: "person", 3: "traffic_light_red", 4: "traffic_light_yellow", 5: "traffic_light_green", 6: "helmet", 7: "license_plate", 8: "crosswalk", 9: "lane_line_solid", 10: "lane_line_dashed", 11: "stop_line", 12: "no_parking_sign"}
VIOLATION_NAMES = {
    "red_light_running": "قطع الإشارة الحمراء",
    "wrong_direction": "السير بالاتجاه المعاكس",
    "no_helmet": "عدم لبس الخوذة",
    "illegal_parking": "الوقوف الخاطئ",
    "illegal_overtaking": "التجاوز الخاطئ",
    "speeding": "السرعة الزائدة",
    "lane_keeping": "عدم الالتزام بالمسار",
    "high_beam_misuse": "إساءة استخدام أنوار التلاقي",
    "unsafe_following": "عدم ترك مسافة آمنة",
    "manual_other": "مخالفة يدوية أخرى",
}
SOURCE_NAMES = {"dashcam": "كاميرا داشبورد", "cctv": "كاميرا مراقبة ثابتة", "social": "سوشل ميديا", "other": "أخرى"}
ORIGIN_NAMES = {"auto": "تلقائي", "manual": "يدوي"}
VIDEO_STATUSES = ["imported", "prelabeled", "reviewed", "analyzed"]
REVIEW_STATUSES = ["pending", "confirmed", "false_positive", "uncertain"]
VIDEO_EXTENSIONS = [".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".flv"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]
ZONE_TYPES = ["stop_line", "lane_line_solid", "lane_line_dashed", "no_parking"]
LANE_LINES = ["lane_line_solid", "lane_line_dashed"]
PLATE_LETTERS = "ابحدرسصطعقكلمنهوي"

VEHICLES = ["vehicle", "motorcycle"]
VIOLATION = "video_id int, violation_type string, track_id int, start_ms int, end_ms int, confidence double, evidence array<int>"
DETECTION = "id bigint, video_id int, frame_no int, timestamp_ms int, class_name string, confidence double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, track_id int"
