"""Word lists that results must agree with, as text."""

#: Words of names and dosage forms that never become links.
LINK_STOP = frozenset("""
SODIUM CHLORHYDRATE SULFATE ACIDE POTASSIUM CALCIUM MAGNESIUM MONOHYDRATE
DIHYDRATE ANHYDRE HYDROXYDE PHOSPHATE CITRATE TARTRATE MALEATE MESILATE
BROMHYDRATE ACETATE CHLORURE GLUCOSE FUMARATE GLUCONATE LACTATE NITRATE
BENZOATE STEARATE OXALATE SUCCINATE DIPROPIONATE
COMPRIME COMPRIMES GELULE GELULES POUDRE SUSPENSION INJECTABLE PELLICULE
PELLICULEE ENROBE ENROBEE SECABLE DISPERSIBLE EFFERVESCENT EFFERVESCENTE
LIBERATION PROLONGEE MODIFIEE FLACON AMPOULE SACHET BUVABLE ORALE RECTALE
NASALE CUTANEE VAGINALE OPHTALMIQUE SOLUTION SOLVANT EMULSION DISPERSION
GRANULES POMMADE COLLYRE GOUTTES UNIDOSE RECIPIENT PERFUSION SIROP CREME
MICROGRAMMES MILLIGRAMMES GASTRORESISTANT GASTRORESISTANTE LYOPHILISAT
INHIBITEUR INHIBITEURS ENZYME RECEPTEUR RECEPTEURS SYSTEME TRAITEMENT
PATIENT PATIENTS EFFETS INDICATION POSOLOGIE GROSSESSE ALLAITEMENT VITAMINE
VITAMINES HORMONE PROTEINE PROTEINES HUMAINE HUMAIN ADULTE ADULTES ENFANT
ENFANTS ASSOCIATION RESISTANT PLAQUETTAIRE PLASMATIQUE SANGUINE CELLULE
CELLULES DILUTION DILUTIONS DEGRE COMPRISE COMPRISES HERBA PLANTA RADIX
FOLIUM RECOMBINANT ACTIVITE BYPASSING FACTEUR COAGULATION IMMUNOGLOBULINE
ALLERGENIQUE POLYOSIDE
""".split())

#: Salts, hydrates and connectors that are dropped from a substance's name.
SUBSTANCE_QUALIFIERS = frozenset("""
CHLORHYDRATE BROMHYDRATE IODHYDRATE SULFATE HEMISULFATE HYDROGENOSULFATE
PHOSPHATE HYDROGENOPHOSPHATE DIHYDROGENOPHOSPHATE ACETATE CITRATE
HYDROGENOCITRATE TARTRATE HYDROGENOTARTRATE BITARTRATE MALEATE MALATE MESILATE
MESYLATE BESILATE BESYLATE TOSILATE FUMARATE HEMIFUMARATE GLUCONATE LACTATE
NITRATE BENZOATE STEARATE OXALATE SUCCINATE HEMISUCCINATE DIPROPIONATE
PROPIONATE PIVALATE VALERATE PAMOATE EMBONATE MALONATE ASPARTATE GLUTAMATE
SACCHARINATE XINAFOATE ENANTATE DECANOATE FUROATE OROTATE CARBONATE BICARBONATE
SODIQUE POTASSIQUE CALCIQUE MAGNESIEN SODIUM POTASSIUM CALCIUM MAGNESIUM
CHLORURE BROMURE HYDROXYDE
HYDRATE HYDRATEE MONOHYDRATE MONOHYDRATEE DIHYDRATE DIHYDRATEE TRIHYDRATE
TRIHYDRATEE TETRAHYDRATE PENTAHYDRATE HEPTAHYDRATE HEMIHYDRATE SESQUIHYDRATE
ANHYDRE
DE D ET
""".split())

#: Query words too frequent to tell sections apart.
QUERY_STOP = frozenset("""
les des une aux avec sans pour dans par sur que qui quoi dont mais donc car
est sont etre ete avoir plus moins tres peut puis lors chez vers cette ces mon
mes son ses nos vos leur leurs quel quelle quels quelles comment quand pourquoi
ainsi cela ceci celui celle vous nous ils elles
""".split())
