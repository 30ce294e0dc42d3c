"""Small fixed tables of Arabic pages, used by queries and tests (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import PAGES

# book_id, page_num, original, content, title, author, category, year, death_year, country
SAMPLE_PAGES = [
    (1, 1, None, "كَتَبَ كاتبٌ كتاباً مكتوباً مكتبة كتابة", "اللغة", None, "اللغة", None, None, None),
    (2, 1, None, "علم العلماء كلَّ الناسِ علم النحو والصرف", "النحو", None, "اللغة", None, None, None),
    (3, 1, None, "قال رسول الله صلى الله عليه وسلم في الحديث", "الحديث", None, "الحديث", None, None, None),
    (4, 1, None, "ضرب الرجل ضرباً شديداً وهو مضروب ضارب", "النحو 2", None, "اللغة", None, None, None),
]

# The library that comes with a new installation: 8 pages of 6 books.
_BUKHARI = ("صحيح البخاري", "البخاري", "الحديث", "0256", "0256", "بخارى")
_FATIHA = ("الفاتحة", None, "القرآن", "0001", None, None)
SAMPLE_LIBRARY = [
    (1, 1, None, "بسم الله الرحمن الرحيم. الحمد لله رب العالمين الرحمن الرحيم مالك يوم الدين", *_FATIHA),
    (1, 2, None, "إياك نعبد وإياك نستعين اهدنا الصراط المستقيم صراط الذين أنعمت عليهم", *_FATIHA),
    (2, 1, None, "كتاب الصلاة. باب وقت الفجر إذا طلع الفجر صلِّ ركعتين قبل صلاة الفجر", *_BUKHARI),
    (2, 2, None, "كتاب الزكاة. من ملك نصاباً وحال عليه الحول وجبت عليه الزكاة من ماله", *_BUKHARI),
    (3, 1, None, "العلم نور والجهل ظلام. اطلبوا العلم من المهد إلى اللحد. العلماء ورثة الأنبياء", "جامع بيان العلم", "ابن عبد البر", "العلم", "0463", "0463", "الأندلس"),
    (4, 1, None, "كاتب يكتب كتاباً مكتوباً مكتبةً كتابةً. كتب الناس فقام كاتبٌ منهم", "نماذج لغوية", None, "اللغة", "0500", None, "العراق"),
    (5, 1, None, "ضرب الرجل ضرباً شديداً وهو مضروب ضارب. الضرب أنواع كثيرة في علم الصرف", "شذا العرف", "الحملاوي", "اللغة", "1316", "1351", "مصر"),
    (6, 1, None, "قال رسول الله صلى الله عليه وسلم: إنما الأعمال بالنيات. وإنما لكل امرئ ما نوى", "الأربعون النووية", "النووي", "الحديث", "0676", "0676", "الشام"),
]

# (text of a file, title by its name)
SAMPLE_FILES = [
    ("[الكتاب]: مختصر في اللغة\n[المؤلف]: فلان\n[السنة]: ٢٥٦هـ\n[المترجم]: علّان\n[التصنيف]: النحو\n[الجنسية]: مصر\nنص الكتاب هنا", "a"),
    ("مقدمة\n==== ١٢ ====\nنص الصفحة\n==== ١٣ ====\n\n==== ١٤ ====\nآخر الكتاب", "b"),
    ("[تاريخ الاستعمال]: 256هـ / 870م\nكلام كثير", "c"),
    ("[السنة]: غير محدّد\n[القسم]: متفرقات\n[تاريخ الاستعمال]: ٩٠٠م", "d"),
]


def sample_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_PAGES, PAGES)


def sample_library_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_LIBRARY, PAGES)


def sample_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"/in/{t}.txt", t, x) for x, t in SAMPLE_FILES], "path string, title string, text string")


def quote(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str, name: str = "t") -> str:
    """The rows as a SQL relation."""
    body = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({columns})"
