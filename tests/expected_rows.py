"""The rows that the rules call for on the literal rows of cases.py, worked out from the rules and looked through one by one."""

ROWS = {
    'answer_checks': (
        ['id', 'answer', 'has_conclusion', 'cited', 'quoted', 'judged', 'poor', 'unverified'],
        [
            (1, '## SONUÇ\n\nBaşlangıç dozu 7.5 mg verilmelidir. [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (10, '## SONUÇ\n\nBu ilaç CYP3A4 inhibitörüdür; varfarin düzeyi azalır. [CYP450] [DOĞRULANAMADI-CYP: inhibitör → düzey artmalı]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (11, '## SONUÇ\n\nBu ilaç CYP3A4 inhibitörüdür; varfarin düzeyi artar. [CYP450]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 0),
            (12, '## SONUÇ\n\nBu ilaç CYP3A4 indükleyicisidir; digoksin düzeyi artar. [CYP450] [DOĞRULANAMADI-CYP: indükleyici → düzey azalmalı]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (13, '## SONUÇ\n\nBu ilaç böbrek yetmezliğinde dikkatli kullanılmalıdır [AŞIRI YORUM: Madde 4.3 retrieve edilmedi, kontrendike kanıtlanamıyor]. [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (14, '## SONUÇ\n\nBaşlangıç dozu 10 mg önerilir. [TEST ILAC | Madde 4.2]\n\n## KAYNAKLAR\n- TEST', True, True, False, False, False, 0),
            (15, '## SONUÇ\nBu kombinasyon genel olarak önerilmez ve kullanılmamalı [TEST ILAC | Madde 4.4]\n\n## UYARI\nTEST ilacı böbrek hastalarında 900 mg ile [SİSTEM DÜZELTMESİ: KÜB verileri bu kombinasyon için spesifik güvenlik onayı içermemektedir. Klinik değerlendirme önerilir.] demek doğru olmaz.', True, True, False, False, False, 0),
            (16, None, None, False, False, False, None, None),
            (17, 'Kısa cevap.', False, False, False, False, False, 0),
            (2, '## SONUÇ\n\nBaşlangıç dozu 2.5 mg verilmelidir. [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (3, '## SONUÇ\n\nBaşlangıç dozu 2.5 mg önerilir. [TEST ILAC | Madde 4.2 — Geriyatrik] [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (4, '## SONUÇ\n\nBaşlangıç dozu 5 mg önerilir. [TEST ILAC | Madde 4.2 — Pozoloji]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 0),
            (5, '## SONUÇ\n\nBu hastanın GFR değeri 55 mL/dak olduğundan doz azaltımı gereklidir. [TEST ILAC | Madde 4.4 — Böbrek]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 0),
            (6, '## SONUÇ\n\nGFR < 15 mL/dak altında kullanım kontrendikedir. [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (7, 'Bu ilaç hamile kadınlarda [SİSTEM DÜZELTMESİ: KÜB verileri bu kombinasyon için spesifik güvenlik onayı içermemektedir. Klinik değerlendirme önerilir.].', False, False, False, False, False, 0),
            (8, '## SONUÇ\n\nBu ilaç renal hastalarda dikkatli kullanılmalıdır [AŞIRI YORUM: Madde 4.3 retrieve edilmedi, kontrendike kanıtlanamıyor]. [DOĞRULANAMADI]\n\n## KAYNAKLAR\n- TEST', True, False, False, False, False, 1),
            (9, '## SONUÇ\n\nBu ilaç hamilelerde kontrendikedir. [TEST ILAC | Madde 4.3]\n\n## KAYNAKLAR\n- TEST', True, True, False, False, False, 0),
        ],
    ),
    'verdict_levels': (
        ['id', 'first', 'level', 'supported'],
        [
            (1, '', 2, 2),
            (10, '', 2, 2),
            (11, '', 2, 2),
            (12, '', 2, 2),
            (13, '', 2, 2),
            (14, '', 2, 2),
            (15, 'Bu kombinasyon genel olarak önerilmez ve kullanılmamalı [TEST ILAC | Madde 4.4]', 4, 4),
            (2, '', 2, 2),
            (3, '', 2, 2),
            (4, '', 2, 2),
            (5, '', 2, 2),
            (6, '', 2, 2),
            (7, '', 2, 2),
            (8, '', 2, 2),
            (9, '', 2, 4),
        ],
    ),
    'patient_profiles': (
        ['id', 'stage', 'flags', 'labs', 'lines'],
        [
            (1, 'Evre 4 (G4, GFR 15-29)', 'geriatric,hepatic,renal', 'ALT:kritik_yüksek,K:kritik_yüksek', 7),
            (2, 'bilinmiyor', 'renal', 'Kreatinin:kritik_yüksek,Na:kritik_düşük', 5),
            (3, 'Evre 2 (G2, GFR 60-89)', 'hepatic,pediatric', 'ALP:kritik_yüksek,GGT:yüksek,Trombosit:kritik_düşük', 5),
            (4, 'Evre 5 (G5, GFR <15 — terminal dönem)', 'geriatric,hepatic,renal', None, 3),
            (5, 'Evre 1 (G1, GFR ≥90)', 'geriatric', 'HbA1c:kritik_yüksek', 3),
        ],
    ),
    'profile_summaries': (
        ['id', 'summary'],
        [
            (1, "Yaş: 70, Cinsiyet: erkek\nBöbrek fonksiyonu: GFR=25.0 mL/dak/1.73m² (Evre 4 (G4, GFR 15-29))\nKaraciğer fonksiyonu: Child-Pugh B (Bu ilaç için KÜB'de özel hepatik kısıt belirtilmemiştir)\nMevcut ilaçlar: ASPIRIN\nEndikasyonlar: Diyabet\nKilo: 80.0 kg\nEk notlar: not"),
            (2, 'Yaş: 30, Cinsiyet: kadın\nDurum: GEBELİK\nAlerjiler: penisilin'),
            (3, 'Yaş: 17, Cinsiyet: belirtilmemiş\nBöbrek fonksiyonu: GFR=60.0 mL/dak/1.73m² (normal sınırlar)\nKaraciğer fonksiyonu: Child-Pugh A\nDurum: EMZİRİYOR'),
            (4, "Yaş: belirtilmemiş, Cinsiyet: belirtilmemiş\nBöbrek fonksiyonu: GFR=14.9 mL/dak/1.73m² (Evre 5 (G5, GFR <15 — terminal dönem))\nKaraciğer fonksiyonu: Child-Pugh C (Bu ilaç için KÜB'de özel hepatik kısıt belirtilmemiştir)"),
            (5, 'Yaş: 65, Cinsiyet: erkek\nBöbrek fonksiyonu: GFR=90.0 mL/dak/1.73m² (normal sınırlar)'),
        ],
    ),
    'question_plans': (
        ['id', 'name', 'kinds', 'sections', 'query', 'n_results'],
        [
            (1, None, 'etkilesim,kontrendikasyon,gebelik_laktasyon', '4.5,4.4,4.3,4.6', 'Parol ile aspirin birlikte kullanılabilir mi? gebelik hamile böbrek fonksiyon bozukluğu kreatinin yüksek', 5),
            (2, 'A', 'doz,gebelik_laktasyon', '4.2,4.6,4.3,4.4,4.5', 'KBY hastasında doz ayarı gerekir mi? kronik böbrek yetmezliği renal yetmezlik pediyatrik çocuk hasta 17 yaş laktasyon emzirme', 5),
            (2, 'B', 'doz,gebelik_laktasyon', '4.2,4.6,4.3,4.4,4.5', 'KBY hastasında doz ayarı gerekir mi? kronik böbrek yetmezliği renal yetmezlik pediyatrik çocuk hasta 17 yaş laktasyon emzirme', 5),
            (3, None, 'gebelik_laktasyon', '4.6,4.3,4.4,4.5,4.2', 'Gebelikte kullanım hakkında bilgi böbrek yetmezliği GFR 14.9 karaciğer yetmezliği Child-Pugh C geriyatrik yaşlı hasta 0 yaş', 5),
            (4, 'A', 'genel', '4.3,4.4,4.5,4.2', 'Bu ilaç hangi firmanın? geriyatrik yaşlı hasta 65 yaş', 5),
            (4, 'B', 'genel', '4.3,4.4,4.5,4.2', 'Bu ilaç hangi firmanın? geriyatrik yaşlı hasta 65 yaş', 5),
            (5, None, 'uyari', '4.4,4.3,4.5,4.2', 'Miyastenia gravis hastasında risk var mı? böbrek yetmezliği GFR 25.0 karaciğer yetmezliği Child-Pugh B geriyatrik yaşlı hasta 70 yaş özel kullanım uyarısı Miyastenia gravis dikkatli kullanım', 5),
            (6, 'A', 'doz,gebelik_laktasyon,doz_asimi', '4.2,4.6,4.3,4.9,4.4,4.5', 'Doz aşımı durumunda ne yapılır, zehirlenme belirtileri? gebelik hamile böbrek fonksiyon bozukluğu kreatinin yüksek', 5),
            (6, 'B', 'doz,gebelik_laktasyon,doz_asimi', '4.2,4.6,4.3,4.9,4.4,4.5', 'Doz aşımı durumunda ne yapılır, zehirlenme belirtileri? gebelik hamile böbrek fonksiyon bozukluğu kreatinin yüksek', 5),
            (7, None, 'gebelik_laktasyon,yan_etki,uyari', '4.6,4.3,4.8,4.4,4.5', 'kanama riski yan etki olarak görülür mü pediyatrik çocuk hasta 17 yaş laktasyon emzirme yan etki istenmeyen etki advers reaksiyon güvenlilik profili kanama riski hemoraji', 5),
            (8, 'A', 'etkilesim', '4.5,4.4,4.3,4.2', 'AF ve KAH öyküsü olan hastada etkileşim? atriyal fibrilasyon aritmisi koroner arter hastalığı iskemik kalp böbrek yetmezliği GFR 14.9 karaciğer yetmezliği Child-Pugh C geriyatrik yaşlı hasta 0 yaş', 5),
            (8, 'B', 'etkilesim', '4.5,4.4,4.3,4.2', 'AF ve KAH öyküsü olan hastada etkileşim? atriyal fibrilasyon aritmisi koroner arter hastalığı iskemik kalp böbrek yetmezliği GFR 14.9 karaciğer yetmezliği Child-Pugh C geriyatrik yaşlı hasta 0 yaş', 5),
        ],
    ),
    'report_values': (
        ['id', 'name', 'value', 'profile'],
        [
            (1, 'ALT', 45.5, False),
            (1, 'ALT', 45.5, True),
            (1, 'HGB', 14.0, False),
            (1, 'Hemoglobin', 14.0, True),
            (1, 'K', 12.0, False),
            (1, 'PLT', 250.0, False),
            (1, 'Trombosit', 250.0, True),
            (1, 'Üre', 31.0, False),
            (1, 'Üre', 31.0, True),
            (4, 'Kreatinin', 0.05, False),
            (4, 'Na', 140.0, False),
            (4, 'Na', 140.0, True),
        ],
    ),
    'lab_texts': (
        ['id', 'name', 'value'],
        [
            (1, 'ALT', 45.0),
            (1, 'AST', 30.0),
            (1, 'Kreatinin', 1.2),
            (1, 'Na', 140.0),
            (2, 'GFR', 90.0),
            (2, 'Hemoglobin', 1.0),
            (2, 'Trombosit', 250.0),
            (3, 'INR', 2.5),
            (3, 'K', 4.1),
        ],
    ),
    'patient_context': (
        ['id', 'age', 'sex', 'weight', 'gfr', 'renal', 'hepatic', 'child_pugh', 'pregnant', 'nursing', 'pediatric', 'geriatric', 'labs', 'diagnoses', 'allergies', 'target', 'current', 'question'],
        [
            (1, 72, 'erkek', 80.0, 45.0, True, False, None, False, False, False, True, 'ALT', '', '', 'klaritromisin', 'Varfarin', 'Hastaya klaritromisin yazabilir miyim?'),
            (2, None, 'kadın', None, None, False, False, None, False, False, False, False, '', 'Hipertansiyon', 'penisilin', 'ramipril eklemek', '', 'Gebe kadın hasta, penisilin alerjisi var. Hipertansiyon için ramipril eklemek istiyorum.'),
            (3, 12, None, None, None, False, True, 'B', False, False, True, False, '', '', '', None, 'metformin,aspirin,insülin', '12 yaş çocuk hasta Child-Pugh b siroz. Mevcut ilaçları: metformin, aspirin ve insülin.'),
            (4, None, None, None, None, False, False, None, False, False, False, False, '', '', '', None, '', 'yaşı bilinmiyor'),
        ],
    ),
    'names_in_texts': (
        ['id', 'name', 'place', 'target'],
        [
            (1, 'ASPIRIN 100 MG', 27, True),
            (1, 'COUMADIN 5 MG TABLET', 6, False),
            (2, 'COUMADIN 5 MG TABLET', 20, False),
            (2, 'KLACID 500 MG', 0, True),
            (4, 'COUMADIN 5 MG TABLET', 0, True),
        ],
    ),
    'text_facts': (
        ['id', 'severity', 'conditions', 'mentions', 'doses', 'roles', 'category', 'ingredients'],
        [
            (1, 'contraindicated', 'peptik ülseri', 'Varfarin', '< 30.0 contraindicated', 'CYP3A4 substrate', None, 'asetilsalisilik'),
            (2, 'moderate', 'gebelik', '', '< 30.0 60.0 dose_reduction; < 45.0 60.0 dose_reduction', 'CYP2D6 inhibitor', 'C', 'suksinat; metoprolol'),
            (3, 'contraindicated', 'gebelik', '', '', '', 'X', 'klopidogrel'),
            (4, 'unknown', '', '', '', '', None, None),
            (5, 'unknown', 'böbrek yetmezliği; astım; böbrek yetmezli̇ği̇', 'Digoksin inhibitör', '', 'CYP3A4 inhibitor', None, 'parasetamol; klorfeniramin'),
        ],
    ),
    'section_parts': (
        ['id', 'place', 'key', 'label', 'flags', 'size', 'digest', 'chunk_id'],
        [
            (1, 0, 'bobrek', 'Böbrek Yetmezliği', 'renal', 172, 'c951e19a0333436b720195f78c04fada', 'ILA__A_4_2_bobrek_ea472bd825'),
            (1, 1, 'pediyatrik', 'Pediyatrik Popülasyon', 'pediatric', 177, '9b7926c0091bce138f9f94478be73252', 'ILA__A_4_2_pediyatrik_caf9717b64'),
            (2, 0, 'bobrek_karaciger', 'Böbrek / Karaciğer Yetmezliği', 'renal,hepatic', 204, 'cc9fc6b2cff1f2732d17723daa086d31', 'ILA__A_4_2_bobrek_karaciger_c6e7b24203'),
            (4, 0, 'part1', 'Özel Uyarılar — Bölüm 1/2', '', 2259, '7cd006cc75c22bb77760d4421d38f74a', 'ILA__A_4_4_part1_9136da371a'),
            (4, 1, 'part2', 'Özel Uyarılar — Bölüm 2/2', '', 2259, '9f9aa270a97386bcb69eaafe1ec805ea', 'ILA__A_4_4_part2_55a4c46f42'),
        ],
    ),
    'page_layouts': (
        ['id', 'text'],
        [
            (1, 'sol üst\nsağ üst\n| a | b |\nalt'),
            (11, '| İlaç | Doz |\n| --- | --- |\n| A B | 5 mg |\n|  | x |'),
            (12, None),
            (2, ''),
        ],
    ),
    'resolved_names': (
        ['q', 'name', 'tier'],
        [
            ('Coumadin', 'COUMADIN 0,5-MG', 3),
            ('Coumadin', 'COUMADIN 5 MG', 3),
            ('KLASID 500', 'KLACID 500', 5),
            ('MG BELOC', 'BELOC ZOK 50 MG', 6),
            ('MG BELOC', 'COUMADIN 0,5-MG', 6),
            ('MG BELOC', 'COUMADIN 5 MG', 6),
            ('beloc zok 50 mg', 'BELOC ZOK 50 MG', 2),
            ('coumadin 0.5 - mg', 'COUMADIN 0,5-MG', 3),
            ('coumadin 0.5 - mg', 'COUMADIN 5 MG', 3),
            ('laci', 'KLACID 500', 6),
            ('varfarin', 'COUMADIN 0,5-MG', 4),
            ('warfarin', 'COUMADIN 0,5-MG', 4),
            ('warfarin', 'COUMADIN 5 MG', 4),
        ],
    ),
    'canonical_names': (
        ['q', 'name', 'tier'],
        [
            ('  ', '  ', 5),
            ('Coumadin', 'COUMADIN 0,5-MG', 3),
            ('Coumadin', 'COUMADIN 5 MG', 3),
            ('KLASID 500', 'KLASID 500', 5),
            ('MG BELOC', 'BELOC ZOK 50 MG', 4),
            ('beloc zok 50 mg', 'BELOC ZOK 50 MG', 1),
            ('coumadin 0.5 - mg', 'COUMADIN 0,5-MG', 2),
            ('laci', 'KLACID 500', 3),
            ('varfarin', 'varfarin', 5),
            ('warfarin', 'warfarin', 5),
            ('yok böyle', 'yok böyle', 5),
        ],
    ),
    'similar_profiles': (
        ['q', 'name', 'tier'],
        [
            ('Varfarin', 'varfarin', 1),
            ('metoprolol süksinat', 'metoprolol tartarat', 3),
            ('metoprolol', 'metoprolol tartarat', 2),
            ('varfarin sodyum', 'varfarin', 2),
        ],
    ),
}
