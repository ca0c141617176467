"""Hand tables for the column functions."""

import pytest
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions import enums, numbers, text, urls

CASES = [
    ('int', numbers.integer_in,[('185 000 km',185000),('12.500',12500),('1 998 cm3',1998),('2024.0',2024),('',None),('abc',None),('12 500',12500)]),
    ('float', numbers.decimal_in,[('12.500',12500.0),('12.5',12.5),('1.234,56',1234.56),('12,5',12.5),('12,500',12500.0),('1.234.567',1234567.0),('-5',5.0),('',None)]),
    ('slug', text.slug,[('Citroën','citroen'),(' Plug-In  Hybrid ','plug-in-hybrid'),('---',None),(None,None),('ﬁat ½','fiat-1-2'),('éa','ea'),('Ⅷx','viiix'),('Straße','stra-e'),('Ã¤b','ab')]),
    ('label', lambda c: enums.canonical_enum(c,fv.PRICE_LABEL_MAP),[('none',None),('below','low'),('Sehr guter Preis','low'),('strange one','strange-one'),('Erhöhter Preis','high')]),
    ('title', lambda c: F.to_json(enums.make_model_version(c)), [('BMW Seria 3 320d','{"make":"BMW","model":"Seria 3","version":"320d"}'),('Land Rover Evoque','{"make":"Land Rover","model":"Evoque"}'),('Foo Bar baz','{"make":"Foo","model":"Bar","version":"baz"}'),('bmw','{"make":"BMW"}'),('mercedes-benz  C  180','{"make":"Mercedes-Benz","model":"C","version":"180"}'),('CITROËN C3','{"make":"Citroën","model":"C3"}'),('BMWX 3','{"make":"BMWX","model":"3"}'),('VW Series','{"make":"VW","model":"Series"}')]),
    ('make', enums.canonical_make,[('citroen','Citroën'),('mercedes benz','Mercedes-Benz'),('Foo  x','Foo x'),('',None)]),
    ('url', urls.url_key,[('https://x/a/?p=1','https://x/a'),('https://x/A#f','https://x/A#f')]),
    ('power', numbers.power_hp,[('110 kW (150 PS)',150),('110 kW',150),('150',150),('(2000 PS)',None),('20 PS',None),(None,None),('abc',None)]),
    ('engine', numbers.engine_cm3,[('2.0 TDI',2000),('1.6 HDI',1600),('1998 ccm',1998),('5,5 l/100km',None),('35 TFSI',None),('2.0 d x',2000),('1.5 d',None),('1998 cm³',1998)]),
    ('id', urls.listing_id_in,[('https://a.de/x?id=445288256','445288256'),('https://a/auto-inserat/x/445288256.html','445288256'),('https://a/x?id=abc',None)]),
    ('place', text.place_name,[("saint-denis o'neil","Saint-Denis O'Neil"),('a1b','A1B'),('MÜNCHEN','München')]),
    ('unesc', text.unescape_html,[('a &amp; b &lt;c&gt; &#233; &#xe9; &nbsp;x &eacute;t &copy2 &unknown; &amp;lt; &notit; &',"a & b <c> é é \xa0x ét ©2 &unknown; &lt; ¬it; &"),('plain','plain')]),
    ('sq', lambda c: urls.set_query_param(c,'page',F.lit(3)),[('https://a/b','https://a/b?page=3'),('https://a/b?x=1&page=2&x=4#f','https://a/b?x=4&page=3#f'),('https://a/b?q=a%20b&e=','https://a/b?q=a+b&e=&page=3')]),
    ('pn', lambda c: urls.set_page_number(c,F.lit(3)),[('https://a/b','https://a/b?pageNumber=3'),('https://a/b?pageNumber=1','https://a/b?pageNumber=3'),('https://a/b?x=1','https://a/b?x=1&pageNumber=3')]),
    ('fuel', enums.reader_fuel,[('Benzin','petrol'),('Hybrid (Benzin/Elektro)','hybrid'),('  ',None),('Gas x','gas')]),
]


@pytest.mark.parametrize("name,function,cases", CASES, ids=[c[0] for c in CASES])
def test_function(spark, name, function, cases):
    df = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", function(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [wanted for _, wanted in cases]
