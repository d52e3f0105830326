"""Synthetic patients; all values are invented."""

import csv

NAMES = ("김하늘", "이바다", "박소리", "최나무", "정가온", "강보람", "조은별", "윤아름", "장미르", "임다솜", "한결이", "오로라", "서리안", "신나래", "권다온", "황새봄", "안누리", "송이든", "전해솔", "홍마루")
HEADER = ("patient_no", "성명", "주민번호", "연락처", "생년월일", "주소", "우편번호", "성별", "나이", "방문일", "진단", "메모")


def patient(i: int) -> list[str]:
    year, month, day = 60 + i % 30, 1 + i % 12, 1 + i % 28
    return [
        f"P-{100101 + i}", NAMES[i % 20], f"{year:02d}{month:02d}{day:02d}-{1 + i % 2}{230000 + i:06d}", f"010-{2000 + i:04d}-{5000 + i:04d}",
        f"19{year:02d}-{month:02d}-{day:02d}", f"서울시 {'강남구' if i % 2 else '서초구'} 새길로 {i + 1}", f"0{6200 + i}", "FM"[i % 2], str(20 + i), f"2024-03-{1 + i % 28:02d}",
        ("감기", "고혈압", "당뇨")[i % 3], f"{NAMES[i % 20]} 환자가 다시 방문. 보호자 010-{7000 + i:04d}-{8000 + i:04d} 연락 바람.",
    ]


def write(path, n: int = 20, header: bool = True) -> list[list[str]]:
    rows = [patient(i) for i in range(n)]
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([HEADER, *rows] if header else rows)
    return rows
