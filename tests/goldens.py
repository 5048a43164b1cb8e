"""Spans with the written forms that they must have; None where the span must be rejected."""

UTTERANCES = [
    ("áp suất bốn phẩy năm bar", [("bốn phẩy năm bar", "MEASURE")], "Áp suất 4,5 bar."),
    ("đạt hai mươi lăm phần trăm", [("hai mươi lăm phần trăm", "PERCENT")], "Đạt 25%."),
    ("thiệt hại hai triệu đồng", [("hai triệu đồng", "MONEY")], "Thiệt hại 2.000.000 đồng."),
    ("xuất phát mười lăm tháng tám năm hai không hai sáu", [("mười lăm tháng tám năm hai không hai sáu", "DATE")], "Xuất phát 15/08/2026."),
    ("cập cảng lúc sáu giờ bốn mươi lăm", [("sáu giờ bốn mươi lăm", "TIME")], "Cập cảng lúc 06:45."),
    ("giờ địa phương u tê xê cộng bảy", [("u tê xê cộng bảy", "TIMEZONE")], "Giờ địa phương UTC+7."),
    ("ê tê a tám giờ mười lăm", [("ê tê a tám giờ mười lăm", "ETA")], "ETA 08:15."),
    ("vị trí mười độ hai mươi lăm phút bắc", [("mười độ hai mươi lăm phút bắc", "COORD")], "Vị trí 10°25′N."),
    ("tàu số hai ba bốn năm sáu bảy tám chín không", [("hai ba bốn năm sáu bảy tám chín không", "MMSI_ID")], "Tàu số 234567890."),
    ("thiết bị giê pê ét hoạt động tốt", [("giê pê ét", "ACRONYM")], "Thiết bị GPS hoạt động tốt."),
    ("gọi trên vê hát ép kênh mười sáu", [("vê hát ép", "ACRONYM"), ("kênh mười sáu", "CHANNEL")], "Gọi trên VHF Kênh 16."),
    ("thuyền trưởng ra lệnh đét xờ lâu a hét", [("đét xờ lâu a hét", "MARITIME_TERM")], "Thuyền trưởng ra lệnh dead slow ahead."),
    ("phát tín hiệu mê đây", [("mê đây", "MARITIME_TERM")], "Phát tín hiệu MAYDAY."),
    ("gửi về operations@coastguard.vn", [("operations@coastguard.vn", "ELECTRONIC")], "Gửi về operations@coastguard.vn."),
    ("xem tại www.vinamarine.gov.vn", [("www.vinamarine.gov.vn", "ELECTRONIC")], "Xem tại www.vinamarine.gov.vn."),
    ("máy chủ 192.168.10.25", [("192.168.10.25", "ELECTRONIC")], "Máy chủ 192.168.10.25."),
    ("liên hệ không chín không tám một hai ba bốn năm sáu", [("không chín không tám một hai ba bốn năm sáu", "TELEPHONE")], "Liên hệ 0908123456."),
    ("theo số mười hai xẹt hai không hai tư nờ đê cê pê", [("số mười hai xẹt hai không hai tư nờ đê cê pê", "LEGAL_DOC_ID")], "Theo Số 12/2024/NĐ-CP."),
    ("thuyền trưởng nguyễn văn hùng báo cáo", [("nguyễn văn hùng", "PERSON_NAME")], "Thuyền trưởng Nguyễn Văn Hùng báo cáo."),
    ("cập cảng hải phòng", [("hải phòng", "LOCATION_NAME")], "Cập cảng Hải Phòng."),
    ("hệ thống pa tri ốt sẵn sàng", [("pa tri ốt", "FOREIGN_NAME")], "Hệ thống Patriot sẵn sàng."),
    ("kế hoạch quý ba", [("quý ba", "QUARTER")], "Kế hoạch Quý III."),
    ("xếp thứ hai toàn quân", [("thứ hai", "ORDINAL")], "Xếp thứ 2 toàn quân."),
    ("tỷ lệ một trên mười", [("một trên mười", "RATIO")], "Tỷ lệ 1:10."),
    ("mã cảng vê en hát pê hát", [("vê en hát pê hát", "PORT_CODE")], "Mã cảng VNHPH."),
    ("biên đội xu ba lăm xuất kích", [("xu ba lăm", "EQUIPMENT_ID")], "Biên đội Su-35 xuất kích."),
    ("ngư lôi ét e tê sáu lăm", [("ét e tê sáu lăm", "EQUIPMENT_ID")], "Ngư lôi SET-65."),
    ("văn bản của u bê en đê tỉnh", [("u bê en đê", "ACRONYM")], "Văn bản của UBND tỉnh."),
    ("lực lượng xê ét bê tuần tra", [("xê ét bê", "ACRONYM")], "Lực lượng CSB tuần tra."),
    ("nhiệt độ âm mười độ xê", [("âm mười độ xê", "MEASURE")], "Nhiệt độ -10°C."),
    ("phần mềm phiên bản một chấm hai chấm ba", [("phiên bản một chấm hai chấm ba", "VERSION")], "Phần mềm 1.2.3."),
    ("trụ sở số mười hai đường Lê Lợi", [("số mười hai đường Lê Lợi", "ADDRESS")], "Trụ sở Số 12 đường Lê Lợi."),
    ("xe biển ba mươi a một hai ba bốn năm", [("ba mươi a một hai ba bốn năm", "VEHICLE_PLATE")], "Xe biển 30A-12345."),
]

SPANS = [
    ("DATE", "ngày mùng một tháng năm", "01/05"),
    ("DATE", "tháng năm", "05"),
    ("DATE", "tháng sáu mươi tám", None),
    ("DATE", "bốn mươi tháng bốn", None),
    ("DATE", "tám chín một nghìn chín trăm sáu mươi chín", "08/09/1969"),
    ("DATE", "ngày ba mươi tám một nghìn chín trăm tám mươi tư", "30/08/1984"),
    ("DATE", "sáu mười một một nghìn chín trăm bảy mươi tám", "06/11/1978"),
    ("DATE", "năm hai nghìn không trăm năm mươi", "2050"),
    ("DATE", "tháng mười hai một chín bảy hai", "12/1972"),
    ("DATE", "tháng năm hai không hai sáu", "05/2026"),
    ("DATE", "mồng chín tháng chín", "09/09"),
    ("DATE", "ngày hai mươi mười một nghìn chín trăm tám mươi tư", "20/10/1984"),
    ("DATE", "ba mươi mốt mười hai một nghìn chín trăm sáu mươi bảy", "31/12/1967"),
    ("DATE", "tháng ba năm một nghìn chín trăm năm mươi tư", "03/1954"),
    ("DATE", "ngày hai tháng chín năm một nghìn chín trăm bốn mươi lăm", "02/09/1945"),
    ("DATE", "mười lăm tháng mười ba", None),
    ("DATE", "một bảy hai nghìn không trăm hai mươi lăm", "01/07/2025"),
    ("DATE", "một nghìn chín trăm năm mươi ba", "1953"),
    ("DATE", "mười một bảy một nghìn chín trăm bảy mươi lăm", "11/07/1975"),
    ("DATE", "tháng mười hai một nghìn chín trăm bảy mươi tám", "12/1978"),
    ("DIGIT_SEQ", "không tám tám hai mươi mốt ba bốn năm sáu", "088213456"),
    ("DIGIT_SEQ", "ba lăm", "35"),
    ("DIGIT_SEQ", "hai tư", "24"),
    ("DIGIT_SEQ", "không ba xyz", None),
    ("CARDINAL", "một nghìn không trăm hai mươi", "1.020"),
    ("CARDINAL", "hai tỷ ba trăm triệu", "2.300.000.000"),
    ("CARDINAL", "trừ hai mươi lăm", "-25"),
    ("CARDINAL", "một hai ba", None),
    ("CARDINAL", "hai nghìn tỷ", "2.000.000.000.000"),
    ("CARDINAL", "trăm", None),
    ("CARDINAL", "một trăm lẻ bảy", "107"),
    ("DECIMAL", "một hai một phẩy năm", "121,5"),
    ("DECIMAL", "âm mười phẩy năm", "-10,5"),
    ("PERCENT", "ba phẩy năm phần trăm", "3,5%"),
    ("FRACTION", "một phần hai", "1/2"),
    ("RANGE", "từ mười đến hai mươi", "10-20"),
    ("VERSION", "một chấm hai", "1.2"),
    ("VERSION", "một", None),
    ("VERSION", "firmware vê tám chấm năm chấm chín", "Firmware v8.5.9"),
    ("TIME", "sáu giờ rưỡi", "06:30"),
    ("TIME", "không giờ", "00:00"),
    ("TIME", "hai mươi lăm giờ", None),
    ("TIME", "sáu giờ bảy mươi", None),
    ("TIMEZONE", "u tê xê trừ năm", "UTC-5"),
    ("ETD", "ê tê đê mười sáu giờ bốn mươi", "ETD 16:40"),
    ("QUARTER", "quý năm", None),
    ("DURATION", "mười một giờ năm mươi lăm phút", "11 giờ 55 phút"),
    ("DURATION", "hai năm ba tháng", "2 năm 3 tháng"),
    ("DURATION", "mười hai giờ năm phút", "12 giờ 5 phút"),
    ("COORD", "mười độ hai mươi lăm phút ba mươi giây bắc một trăm lẻ bảy độ tám phút mười lăm giây đông", "10°25′30″N, 107°08′15″E"),
    ("COORD", "mười độ bắc", "10°N"),
    ("COORD", "mười hai bắc", None),
    ("COORD", "mười độ chín nghìn phút ba mươi giây bắc", None),
    ("COORD", "mười độ hai mươi lăm phẩy không năm phút bắc", "10°25.05′N"),
    ("HEADING", "không không chín", "009°"),
    ("HEADING", "chín mươi", "090°"),
    ("HEADING", "ba bảy không", None),
    ("MEASURE", "một trăm hai mươi mét khối một giờ", "120 m³/h"),
    ("SPEED", "mười hai hải lý một giờ", "12 kn"),
    ("SPEED", "mười hai ki lô gam", None),
    ("MEASURE", "hai mươi lăm quả", None),
    ("MEASURE", "ki lô mét", None),
    ("DRAFT", "tám phẩy hai mét", "8,2 m"),
    ("FREQUENCY", "một hai một phẩy năm mê ga héc", "121,5 MHz"),
    ("IMO_ID", "i em ô chín không bảy bốn bảy hai chín", "IMO 9074729"),
    ("CALLSIGN", "ba vê hát a", "3VHA"),
    ("PORT_CODE", "ét giê ét i en", "SGSIN"),
    ("DOCUMENT_ID", "số mười hai xẹt hai không hai tư", "Số 12/2024"),
    ("DOCUMENT_ID", "số năm xẹt hai không hai tư", "Số 5/2024"),
    ("LEGAL_DOC_ID", "ích ích ích", None),
    ("LEGAL_DOC_ID", "số hai mươi hai năm hai nghìn không trăm hai mươi tư nghị định chính phủ", "Số 22/2024/NĐ-CP"),
    ("LEGAL_DOC_ID", "số một trăm sáu mươi lăm xẹt hai nghìn mười chín en quy cê pê", "Số 165/2019/NQ-CP"),
    ("LEGAL_DOC_ID", "số chín năm hai nghìn không trăm hai mươi lăm thông tư bộ quốc phòng", "Số 9/2025/TT-BQP"),
    ("TELEPHONE", "cộng tám bốn chín không tám một hai ba bốn năm sáu", "+84 908 123 456"),
    ("TELEPHONE", "một chín không không một hai ba bốn", "1900 1234"),
    ("VEHICLE_PLATE", "bảy bốn gờ gạch chín chín bảy dấu chấm ba sáu", "74G-997.36"),
    ("VEHICLE_PLATE", "a bê xê", None),
    ("ELECTRONIC", "một chín hai chấm một sáu tám chấm mười chấm hai lăm", "192.168.10.25"),
    ("ELECTRONIC", "00:1a:2b:3c:4d:5e", "00:1A:2B:3C:4D:5E"),
    ("ELECTRONIC", "i p v sáu", "IPv6"),
    ("ELECTRONIC", "i p phiên bản sáu", "IPv6"),
    ("ELECTRONIC", "giao thức i p phiên bản sáu", "IPv6"),
    ("ELECTRONIC", "xin chào các bạn", None),
    ("ELECTRONIC", "vê kép vê kép vê kép chấm vinamarine chấm gov chấm vê en", "www.vinamarine.gov.vn"),
    ("ELECTRONIC", "một trăm chín mươi hai chấm một trăm sáu mươi tám chấm mười chấm hai mươi lăm", "192.168.10.25"),
    ("ADDRESS", "số mười hai trần phú", "Số 12 Trần Phú"),
    ("ADDRESS", "lô bi tám gạch tám bốn hai", "Lô B8-842"),
    ("ADDRESS", "số mười tám trên năm trần phú", "Số 18/5 Trần Phú"),
    ("FOREIGN_NAME", "cờ lô ri ban đờ", None),
    ("FOREIGN_NAME", "pat ri ốt", "Patriot"),
    ("RANK", "đại tá", "Đại tá"),
    ("RANK", "chief officer", "Chief Officer"),
    ("MONEY", "hai triệu", None),
    ("MONEY", "năm trăm nghìn đồng", "500.000 đồng"),
    ("CHANNEL", "channel không sáu", "Channel 06"),
    ("PORT_CODE", "vê en hát pê a", "VNHPA"),
    ("EQUIPMENT_ID", "su ba mươi", "Su-30"),
    ("EQUIPMENT_ID", "míc hai mốt", "MiG-21"),
    ("EQUIPMENT_ID", "mi mười bảy", "Mi-17"),
    ("EQUIPMENT_ID", "ka hát ba lăm", "Kh-35"),
    ("EQUIPMENT_ID", "a ka bốn bảy", "AK-47"),
    ("EQUIPMENT_ID", "ép mười sáu", "F-16"),
    ("EQUIPMENT_ID", "bê năm hai", "B-52"),
    ("EQUIPMENT_ID", "em mười sáu", "M16"),
    ("EQUIPMENT_ID", "em bốn a một", "M4A1"),
    ("EQUIPMENT_ID", "rờ pê giê bảy", "RPG-7"),
    ("EQUIPMENT_ID", "tê chín mươi", "T-90"),
    ("EQUIPMENT_ID", "su ba mươi em ka hai", "Su-30MK2"),
    ("EQUIPMENT_ID", "ka hai tám", "Ka-28"),
    ("EQUIPMENT_ID", "pê tám trăm", "P-800"),
    ("EQUIPMENT_ID", "em u chín mươi", "MU90"),
    ("EQUIPMENT_ID", "em ca bốn sáu", "MK 46"),
    ("EQUIPMENT_ID", "năm ba sáu lăm ka e", "53-65KE"),
    ("EQUIPMENT_ID", "a ka sáu trăm ba mươi", "AK-630"),
    ("EQUIPMENT_ID", "con mèo", None),
    ("EQUIPMENT_ID", "ét u gạch ngang ba không em ca hai", "Su-30MK2"),
    ("EQUIPMENT_ID", "a ca gạch ngang sáu ba không", "AK-630"),
    ("EQUIPMENT_ID", "ép hai hai", "F-22"),
    ("EQUIPMENT_ID", "em i gạch ngang một bảy", "Mi-17"),
]
