"""Names of the provinces and how the fuel service spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 81 provinces.
PROVINCES = (
    "ADANA ADIYAMAN AFYONKARAHİSAR AĞRI AKSARAY AMASYA ANKARA ANTALYA ARDAHAN ARTVİN AYDIN BALIKESİR BARTIN BATMAN BAYBURT BİLECİK BİNGÖL BİTLİS BOLU "
    "BURDUR BURSA ÇANAKKALE ÇANKIRI ÇORUM DENİZLİ DİYARBAKIR DÜZCE EDİRNE ELAZIĞ ERZİNCAN ERZURUM ESKİŞEHİR GAZİANTEP GİRESUN GÜMÜŞHANE HAKKARİ HATAY "
    "IĞDIR ISPARTA İSTANBUL İZMİR KAHRAMANMARAŞ KARABÜK KARAMAN KARS KASTAMONU KAYSERİ KIRIKKALE KIRKLARELİ KIRŞEHİR KİLİS KOCAELİ KONYA KÜTAHYA MALATYA "
    "MANİSA MARDİN MERSİN MUĞLA MUŞ NEVŞEHİR NİĞDE ORDU OSMANİYE RİZE SAKARYA SAMSUN SİİRT SİNOP SİVAS ŞANLIURFA ŞIRNAK TEKİRDAĞ TOKAT TRABZON TUNCELİ UŞAK "
    "VAN YALOVA YOZGAT ZONGULDAK"
).split()
# Spellings of the service that are not the name in ASCII letters.
SPELLED = {
    "AFYONKARAHİSAR": "AFYON", "ELAZIĞ": "ELAZIĞ", "GAZİANTEP": "GAZİANTEP", "KAHRAMANMARAŞ": "K.MARAS", "MARDİN": "MARDİN", "MERSİN": "İÇEL", "NİĞDE": "NİĞDE",
    "SİNOP": "SİNOP", "ŞANLIURFA": "ŞANLIURFA",
}


def upper_name(c: Column) -> Column:
    """Upper case by Turkish letters, trimmed."""
    return F.upper(F.translate(F.trim(c), "iı", "İI"))


def service_name(c: Column) -> Column:
    """The service's spelling of a province in any case; null for other names."""
    name = upper_name(c)
    plain = F.translate(name, "ÇĞİÖŞÜ", "CGIOSU")
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv]), name)
    return F.when(name.isin(*PROVINCES), F.coalesce(own, plain))


def province_of(c: Column) -> Column:
    """The province that the service's spelling means, or that the name in ASCII letters means; null for other names."""
    back = {**{p.translate(str.maketrans("ÇĞİÖŞÜ", "CGIOSU")): p for p in PROVINCES}, **{p: p for p in PROVINCES}, **{v: k for k, v in SPELLED.items()}}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), upper_name(c))
