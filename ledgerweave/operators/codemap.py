"""Code map of the service request tables: (family, code, description) rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: code families in their natural order -------------------------------
CODE_MAP: dict[str, dict[int, str]] = {
    "status_code": {
        0: "수락대기",
        15: "상담거절",
        14: "매칭완료",
        16: "대면예정",
        17: "대면완료",
        18: "미대면종료",
        19: "대면후종료",
        11: "계약완료",
        12: "계약인증",
        13: "계약신고",
        20: "계약실패",
        7: "LEGACY_상담중단",
    },
    "rejectreason_code": {
        0: "일정임박",
        1: "상담인원부족",
        2: "시공인원부족",
        3: "최소예산미달",
        4: "고객예산부족",
        5: "시공불가지역",
        6: "주력분야아님",
        7: "자동거절",
        8: "너무먼일정",
        99: "직접입력",
        999: "UNKNOWN",
    },
    "cancellationreason_code": {
        0: "일정임박",
        1: "상담인원_부족",
        2: "시공인원_부족",
        3: "최소예산기준_미달",
        4: "고객예산_부족",
        5: "시공불가지역",
        6: "고객_연락불가",
        7: "고객_취소요청",
        8: "고객_시공의사_철회",
        9: "요구사항_대응불가",
        10: "타업체_계약",
        11: "너무_먼_일정",
        99: "직접입력",
        999: "UNKNOWN",
    },
    "inflowchannel_code": {
        0: "맞춤업체추천",
        1: "리스팅",
        2: "시공사례",
        3: "시공스토어(legacy)",
        4: "자동추천(deprecated)",
        5: "자동매칭(deprecated)",
        6: "추가매칭(deprecated)",
        99: "이벤트",
    },
    "residencetype_code": {
        0: "아파트",
        1: "오피스텔",
        2: "빌라",
        3: "단독주택",
        4: "사무공간",
        5: "상업공간",
        6: "외식_상업공간",
        7: "매장_상업공간",
        8: "오피스_상업공간",
        9: "교육_상업공간",
        10: "숙박_상업공간",
        11: "기타_상업공간",
    },
    "hopedschedule_code": {
        10: "1주일 이내",
        11: "1주~2주 이내",
        12: "2주~1달 이내",
        13: "3주~1달 이내",
        100: "1달~2달 이내",
        101: "2달~3달 이내",
        102: "2달 이후",
        103: "3달 이후",
    },
    "matchingstrategy_code": {
        0: "수동_초도매칭",
        1: "수동_추가매칭",
        2: "자동_초도매칭",
        3: "자동_추가매칭",
        999999: "UNKNOWN",
    },
    "scale": {0: "종합", 1: "개별", 2: "상업/카페"},
    "expertises": {
        5: "종합",
        6: "도배",
        7: "욕실",
        8: "페인트",
        9: "마루",
        10: "도어",
        11: "조명",
        12: "주방",
        13: "전문디자인",
        14: "방산시장",
        15: "기타",
        16: "장판",
        17: "목공",
        18: "타일",
        19: "시트필름",
        20: "샷시",
        21: "블라인드",
        22: "설비",
        23: "바닥재",
        24: "발코니확장",
        25: "전기조명",
        26: "상업/카페",
    },
    "rating": {0: "준회원1", 1: "준회원2", 2: "정회원", 3: "인증회원", 4: "멤버십", 99: "UNKNOWN"},
    "closingreason": {
        0: "허수_대면_실측불가",
        1: "허수_가견적요청",
        2: "허수_부동산계약_전",
        3: "취소_오신청",
        4: "취소_시공미정_취소",
        5: "취소_타업체선정",
        6: "취소_사유미확인",
        7: "일정_공사기간_불충분",
        8: "일정_보관이사불가",
        9: "일정_너무먼일정",
        10: "매칭가능업체없음",
        11: "시공불가지역",
        12: "연락처_오류",
        13: "비시공영역",
        14: "연락부재",
        15: "중복_DB",
        16: "테스트",
        17: "기타",
    },
    "residencestatus": {
        2001: "현재공실",
        2002: "시공 시 공실예정",
        2003: "거주중(부분시공)",
        2004: "거주중(보관이사)",
    },
    "mr_status": {
        0: "매칭대기 (초기상태)",
        1: "매칭완료 (1곳 이상 매칭 시킨 경우)",
        2: "매칭종료 (어드민 상에서 매칭종료 버튼 클릭 - 종료사유필요)",
        3: "매칭실패 (모든 업체에서 상담 거절)",
        9999999: "시스템오류",
    },
    "inflowchannel": {
        0: "간편",
        1: "동시신청",
        2: "알림톡",
        95: "이벤트",
        96: "이벤트",
        97: "이벤트",
        98: "이벤트",
        99: "이벤트",
        5: "legacy-5",
    },
    "o2o_impression": {1: "시공 우수업체리스트 카드", 2: "시공 전문가리스트 카드"},
    "clean_channel": {1: "O2O홈(직접)", 2: "이사", 3: "입주공구"},
}


def code_map_rows() -> list[tuple[str, int, str]]:
    return [(family, code, text) for family, codes in CODE_MAP.items() for code, text in codes.items()]


def code_map(spark: SparkSession, rows: Iterable[tuple[str, int, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(list(rows or code_map_rows()), "col string, code int, description string")


def write_code_map(df: DataFrame, path: str) -> None:
    """Replace the Snappy parquet table at ``path``; the rows are a small list, so one file is
    written; what computes them keeps its own parallelism."""
    df.repartition(1).write.mode("overwrite").option("compression", "snappy").parquet(path)
