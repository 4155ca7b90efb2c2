"""One message of each type as bytes, packed by struct formats apart from this package's layouts, and what its fields say. Fixed values."""

from __future__ import annotations

#: Type, bytes in hex.
MESSAGES = {
    "S": "530000000125CA5FF423154F",
    "R": "520000000125CA5FF423154853415254202020474E000000644E4F4320504E4E314E000000004E",
    "H": "480000000125CA5FF42315485341525420202054004D574331",
    "Y": "590000000125CA5FF42315485341525420202030",
    "L": "4C0000000125CA5FF423154C4F4F4648534152542020204E4E41",
    "V": "560000000125CA5FF42315000000746A61CA400000005D21EB306000000045D974498C",
    "W": "570000000125CA5FF4231532",
    "K": "4B0000000125CA5FF4231548534152542020200000C0FD410012C6A4",
    "A": "410000000125CA5FF42315000000000000002A420000006448534152542020200012C6A4",
    "F": "460000000125CA5FF42315000000000000002A420000006448534152542020200012C6A44C4F4F46",
    "E": "450000000125CA5FF42315000000000000002A0000012C000000000000013D",
    "C": "430000000125CA5FF42315000000000000002A0000012C000000000000013D590012C6A4",
    "X": "580000000125CA5FF42315000000000000002A0000012C",
    "D": "440000000125CA5FF42315000000000000002A",
    "U": "550000000125CA5FF42315000000000000002A0000000000001092000000640023B6F8",
    "P": "500000000125CA5FF423150000000000001092420000006448534152542020200012C6A4000000000023B6F8",
    "Q": "510000000125CA5FF42315000000000006790848534152542020200012C6A4000000000023B6F848",
    "B": "420000000125CA5FF42315000000000023B6F8",
    "I": "490000000125CA5FF42315000000000280DE8000000000000679084248534152542020200023B6F80012C6A4000D94F44F41",
}

#: Type, fields as text.
FIELDS = {
    "S": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 event_code=O",
    "R": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 stock=HSART market_category=G financial_status=N round_lot=100 roundlots_only=N classification=O subtype=C authenticity=P short_sale=N ipo=N luld_tier=1 etp=N etp_leverage=0 inverse=N",
    "H": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 stock=HSART state=T reserved=0 reason=MWC1",
    "Y": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 stock=HSART action=0",
    "L": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 mpid=LOOF stock=HSART primary=N mode=N state=A",
    "V": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 level_1=500001000000 level_2=400001020000 level_3=300001020300",
    "W": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 level=2",
    "K": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 stock=HSART release_seconds=49405 qualifier=A px=1230500",
    "A": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 side=B shares=100 stock=HSART px=1230500",
    "F": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 side=B shares=100 stock=HSART px=1230500 mpid=LOOF",
    "E": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 shares=300 match=317",
    "C": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 shares=300 match=317 printable=Y exec_px=1230500",
    "X": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 shares=300",
    "D": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42",
    "U": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=42 new_order_id=4242 shares=100 px=2340600",
    "P": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 order_id=4242 side=B shares=100 stock=HSART px=1230500 match=2340600",
    "Q": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 shares=424200 stock=HSART px=1230500 match=2340600 cross_type=H",
    "B": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 match=2340600",
    "I": "stock_locate=0 tracking_number=1 ts_ns=41551123456789 paired=42000000 imbalance=424200 direction=B stock=HSART far=2340600 near=1230500 reference=890100 cross_type=O variation=A",
}
