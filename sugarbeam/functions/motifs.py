"""The named motifs of annotation: name, sequence, and the place of each residue."""

from __future__ import annotations

import csv
import io
import re

# The motif list, in its own order and form.
MOTIF_LIST = """motif_name,motif,termini_spec
Terminal_LewisX,Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['terminal', 'terminal', 'flexible']"
Internal_LewisX,!Fuc(a1-2)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['flexible', 'internal', 'terminal', 'flexible']"
LewisY,Fuc(a1-2)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
SialylLewisX,Sia(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
SulfoSialylLewisX,Sia(a2-3)GalOS(b1-4)[Fuc(a1-3)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
Terminal_LewisA,Gal(b1-3)[Fuc(a1-4)]GlcNAc,"['terminal', 'terminal', 'flexible']"
Internal_LewisA,!Fuc(a1-2)Gal(b1-3)[Fuc(a1-4)]GlcNAc,"['flexible', 'internal', 'terminal', 'flexible']"
LewisB,Fuc(a1-2)Gal(b1-3)[Fuc(a1-4)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
SialylLewisA,Sia(a2-3)Gal(b1-3)[Fuc(a1-4)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
SulfoLewisA,GalOS(b1-3)[Fuc(a1-4)]GlcNAc,"['terminal', 'terminal', 'flexible']"
H_antigen_type2,Fuc(a1-2)Gal(b1-4)GlcNAc,"['terminal', 'flexible', 'flexible']"
H_antigen_type1,Fuc(a1-2)Gal(b1-3)GlcNAc,"['terminal', 'flexible', 'flexible']"
H_antigen_type3,Fuc(a1-2)Gal(b1-3)GalNAc(a1-3)[Fuc(a1-2)]Gal,"['terminal', 'flexible', 'flexible', 'terminal', 'flexible']"
A_antigen,Fuc(a1-2)[GalNAc(a1-3)]Gal,"['terminal', 'terminal', 'flexible']"
A_antigen_type1,Fuc(a1-2)[GalNAc(a1-3)]Gal(b1-3)GlcNAc,"['terminal', 'terminal', 'flexible', 'flexible']"
A_antigen_type2,Fuc(a1-2)[GalNAc(a1-3)]Gal(b1-4)GlcNAc,"['terminal', 'terminal', 'flexible', 'flexible']"
A_antigen_type3,Fuc(a1-2)[GalNAc(a1-3)]Gal(b1-3)GalNAc(a1-3)[Fuc(a1-2)]Gal,"['terminal', 'terminal', 'flexible', 'flexible', 'terminal', 'flexible']"
B_antigen,Fuc(a1-2)[Gal(a1-3)]Gal,"['terminal', 'terminal', 'flexible']"
B_antigen_type1,Fuc(a1-2)[Gal(a1-3)]Gal(b1-3)GlcNAc,"['terminal', 'terminal', 'flexible', 'flexible']"
B_antigen_type2,Fuc(a1-2)[Gal(a1-3)]Gal(b1-4)GlcNAc,"['terminal', 'terminal', 'flexible', 'flexible']"
ExtB,GalNAc(b1-3)Gal(a1-3)[Fuc(a1-2)]Gal,"['terminal', 'flexible', 'terminal', 'flexible']"
Galili_antigen,Gal(a1-3)Gal(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible']"
GloboH,Fuc(a1-2)Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['terminal', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Gb5,Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Gb4,GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Gb3,Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal']"
3SGb3,Sia(a2-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
8DSGb3,Sia(a2-8)Sia(a2-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
3SGb4,Sia(a2-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
8DSGb4,Sia(a2-8)Sia(a2-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
6DSGb4,Sia(a2-3)[Sia(a2-6)]GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'flexible']"
3SGb5,Sia(a2-3)Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
8DSGb5,Sia(a2-8)Sia(a2-3)Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
6DSGb5,Sia(a2-3)[Sia(a2-6)]Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
6DSGb5_2,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'flexible']"
6SGb3,Sia(a2-6)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
8DSGb3_2,Sia(a2-8)Sia(a2-6)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
6SGb4,Sia(a2-6)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
8DSGb4_2,Sia(a2-8)Sia(a2-6)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
6SGb5,Sia(a2-6)Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
8DSGb5_2,Sia(a2-8)Sia(a2-6)Gal(b1-3)GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
66DSGb5,Sia(a2-6)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-3)Gal(a1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'flexible']"
Forssman_antigen,GalNAc(a1-3)GalNAc(b1-3)Gal,"['flexible', 'flexible', 'flexible']"
iGb3,Gal(a1-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal']"
I_antigen,Gal(b1-4)GlcNAc(b1-3)[Gal(b1-4)GlcNAc(b1-6)]Gal,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
i_antigen,Gal(b1-4)GlcNAc(b1-3)[!GlcNAc(b1-6)]Gal,"['flexible', 'flexible', 'flexible', 'flexible']"
PI_antigen,Gal(a1-4)Gal(a1-4)GlcNAc,"['flexible', 'flexible', 'flexible']"
Chitobiose,GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible']"
Trimannosylcore,Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
Internal_LacNAc_type1,Gal(b1-3)GlcNAc,"['internal', 'flexible']"
Terminal_LacNAc_type1,Gal(b1-3)GlcNAc,"['terminal', 'flexible']"
Internal_LacNAc_type2,Gal(b1-4)GlcNAc,"['internal', 'flexible']"
Terminal_LacNAc_type2,Gal(b1-4)GlcNAc,"['terminal', 'flexible']"
Internal_LacdiNAc_type1,GalNAc(b1-3)GlcNAc,"['internal', 'flexible']"
Terminal_LacdiNAc_type1,GalNAc(b1-3)GlcNAc,"['terminal', 'flexible']"
Internal_LacdiNAc_type2,GalNAc(b1-4)GlcNAc,"['internal', 'flexible']"
Terminal_LacdiNAc_type2,GalNAc(b1-4)GlcNAc,"['terminal', 'flexible']"
bisectingGlcNAc,GlcNAc(b1-4)Man(b1-4)GlcNAc,"['terminal', 'flexible', 'flexible']"
VIM,Sia(a2-3)Gal(b1-4)GlcNAc(b1-3)Gal,"['flexible', 'flexible', 'flexible', 'flexible']"
PolyLacNAc,Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible']"
Ganglio_Series,Gal(b1-3)GalNAc(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Lacto_Series(LewisC),Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
NeoLacto_Series,Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
betaGlucan,Glc(b1-3)Glc(b1-3)Glc,"['flexible', 'flexible', 'flexible']"
KeratanSulfate,Gal(b1-4)GlcNAc6S(b1-3)Gal(b1-4)GlcNAc6S,"['flexible', 'flexible', 'flexible', 'flexible']"
Hyaluronan,GlcA(b1-3)GlcNAc(b1-4)GlcA(b1-3)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible']"
Mollu_series,GlcNAc(b1-2)Man(a1-3)Man(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Arthro_series,GalNAc(b1-4)GlcNAc(b1-3)Man(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Cellulose_like,Glc(b1-4)Glc(b1-4)Glc(b1-4)Glc,"['flexible', 'flexible', 'flexible', 'flexible']"
Chondroitin_4S,GlcA(b1-3)GalNAc4S(b1-4)GlcA(b1-3)GalNAc4S,"['flexible', 'flexible', 'flexible', 'flexible']"
GPI_anchor,Man(a1-2)Man(a1-6)Man(a1-4)GlcN,"['flexible', 'flexible', 'flexible', 'terminal']"
Isoglobo_series,GalNAc(b1-3)Gal(a1-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
LewisD,Fuc(a1-2)Gal(b1-3)GlcNAc(b1-3)Gal(b1-4)Glc,"['terminal', 'flexible', 'flexible', 'flexible', 'flexible']"
Globo_series,GalNAc(b1-3)Gal(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Sda,Sia(a2-3)[GalNAc(b1-4)]Gal,"['terminal', 'terminal', 'flexible']"
SDA,Sia(a2-3)[GalNAc(b1-4)]Gal(b1-4)GlcNAc(b1-3)Gal,"['terminal', 'terminal', 'flexible', 'flexible', 'flexible']"
Muco_series,Gal(b1-3)Gal(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
Heparin,IdoA(a1-4)GlcN2S6S(b1-4)IdoA2S(a1-4)GlcN2S6S,"['flexible', 'flexible', 'flexible', 'flexible']"
Peptidoglycan,MurNAc(b1-4)GlcNAc(b1-4)MurNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible']"
Dermatansulfate,D-IdoA(b1-3)GalNAc4S(b1-4)D-IdoA(b1-3)GalNAc4S,"['flexible', 'flexible', 'flexible', 'flexible']"
CAD,Sia(a2-3)[GalNAc(b1-4)]Gal(b1-3)[Sia(a2-6)]GalNAc,"['terminal', 'terminal', 'flexible', 'terminal', 'flexible']"
Lactosylceramide,Gal(b1-4)Glc1Cer,"['flexible','flexible']"
Lactotriaosylceramide,GlcNAc(b1-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal']"
LexLex,Fuc(a1-3)[Gal(b1-4)]GlcNAc(b1-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['terminal', 'terminal', 'flexible', 'flexible', 'terminal', 'flexible']"
GM3,Sia(a2-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal']"
H_type3,Fuc(a1-2)Gal(b1-3)GalNAc,"['terminal', 'flexible', 'flexible']"
GM2,Sia(a2-3)[GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible']"
GM1,Sia(a2-3)[Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible', 'flexible']"
cisGM1,Sia(a2-3)Gal(b1-3)GalNAc(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
VIM2,Sia(a2-3)Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
GD3,Sia(a2-8)Sia(a2-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
GD1a,Sia(a2-3)Gal(b1-3)GalNAc(b1-4)[Sia(a2-3)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible']"
GD2,Sia(a2-8)Sia(a2-3)[GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible']"
GD1b,Sia(a2-8)Sia(a2-3)[Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible']"
SDLex,Sia(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal', 'flexible']"
Fuc_LN3,Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc(b1-3)Gal(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible']"
GT1b,Sia(a2-8)Sia(a2-3)[Sia(a2-3)Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
GD1,Sia(a2-8)Sia(a2-3)Gal(b1-3)GalNAc(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
GD1a_2,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal']"
LcGg4,GlcNAc(b1-3)[GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'terminal']"
GT3,Sia(a2-8)Sia(a2-8)Sia(a2-3)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Disialyl_T_antigen,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc,"['flexible', 'flexible', 'flexible', 'flexible']"
GT1a,Sia(a2-8)Sia(a2-3)Gal(b1-4)GalNAc(b1-4)[Sia(a2-3)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'terminal']"
GT2,Sia(a2-8)Sia(a2-8)Sia(a2-3)[GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'terminal']"
GT1c,Sia(a2-8)Sia(a2-8)Sia(a2-3)[Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal']"
2Fuc_GM1,Sia(a2-3)[Fuc(a1-2)Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
GQ1c,Sia(a2-8)Sia(a2-8)Sia(a2-3)[Sia(a2-3)Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
O_linked_mannose,Sia(a2-3)Gal(b1-4)GlcNAc(b1-2)Man,"['flexible', 'flexible', 'flexible', 'terminal']"
GT1aa,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-4)[Sia(a2-3)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'terminal', 'flexible', 'terminal']"
GQ1b,Sia(a2-8)Sia(a2-3)[Sia(a2-8)Sia(a2-3)Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
HNK1,GlcA3S(b1-3)Gal(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible']"
GQ1ba,Sia(a2-8)Sia(a2-3)[Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal']"
O_mannose_Lex,Fuc(a1-3)[Gal(b1-4)]GlcNAc(b1-2)Man,"['terminal', 'terminal', 'flexible', 'terminal']"
2Fuc_GD1b,Sia(a2-8)Sia(a2-3)[Fuc(a1-2)Gal(b1-3)GalNAc(b1-4)]Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
Sialopentaosylceramide,Sia(a2-3)[GalNAc(b1-4)]Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)Glc1Cer,"['flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
Sulfogangliotetraosylceramide,GalOS(b1-3)GalNAc(b1-4)Gal(b1-4)Glc1Cer,"['flexible', 'flexible', 'flexible', 'terminal']"
B-GM1,Fuc(a1-2)[Gal(a1-3)]Gal(b1-3)GalNAc(b1-4)[Sia(a2-3)]Gal(b1-4)Glc1Cer,"['terminal', 'terminal', 'flexible', 'flexible', 'terminal', 'flexible', 'terminal']"
GQ1aa,Sia(a2-8)Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-4)[Sia(a2-3)]Gal(b1-4)Glc1Cer,"['terminal', 'flexible', 'flexible', 'terminal', 'flexible', 'terminal', 'flexible', 'terminal']"
bisSulfo-Lewis x,Sia(a2-3)GalOS(b1-4)[Fuc(a1-3)]GlcNAcOS,"['terminal', 'flexible', 'terminal', 'flexible']"
para-Forssman,GalNAc(b1-3)GalNAc(b1-3)Gal,"['flexible', 'flexible', 'flexible']"
core_fucose,GlcNAc(b1-4)[Fuc(a1-6)]GlcNAc,"['flexible', 'flexible', 'flexible']"
core_fucose(a1-3),GlcNAc(b1-4)[Fuc(a1-3)]GlcNAc,"['flexible', 'flexible', 'flexible']"
GP1c,Sia(a2-8)Sia(a2-3)Gal(b1-3)GalNAc(b1-4)[Sia(a2-8)Sia(a2-8)Sia(a2-3)]Glc1Cer,"['terminal', 'flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal']"
B-GD1b,Fuc(a1-2)[Gal(a1-3)]Gal(b1-3)GalNAc(b1-4)[Sia(a2-8)Sia(a2-3)]Gal(b1-4)Glc1Cer,"['terminal', 'terminal', 'flexible', 'flexible', 'terminal', 'flexible', 'flexible', 'terminal']"
GP1ca,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GalNAc(b1-4)[Sia(a2-8)Sia(a2-8)Sia(a2-3)]Gal(b1-4)Glc1Cer,"['terminal', 'flexible', 'terminal', 'flexible', 'terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
Isoglobotetraosylceramide,GalNAc(b1-3)Gal(a1-3)Gal1Cer,"['flexible', 'flexible', 'terminal']"
polySia,Sia(a2-8)Sia(a2-8)Sia,"['flexible', 'flexible', 'flexible']"
high_mannose,Man(a1-3)[Man(a1-6)]Man(a1-6)[Man(a1-3)]Man(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
Gala_series,Gal(a1-4)Gal1Cer,"['flexible', 'terminal']"
LPS_core,Kdo(a2-4)Kdo(a2-6)GlcN(b1-6)GlcN,"['flexible', 'flexible', 'flexible', 'terminal']"
Nglycan_complex,GlcNAc(b1-2)Man(a1-3)[GlcNAc(b1-2)Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Nglycan_complex2,GlcNAc(b1-4)Man(a1-3)[GlcNAc(b1-4)Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Oglycan_core1,Gal(b1-3)[!GlcNAc(b1-6)]GalNAc,"['flexible', 'flexible', 'terminal']"
Oglycan_core2,Gal(b1-3)[GlcNAc(b1-6)]GalNAc,"['flexible', 'flexible', 'flexible']"
Oglycan_core3,GlcNAc(b1-3)[!GlcNAc(b1-6)]GalNAc,"['flexible', 'flexible', 'terminal']"
Oglycan_core4,GlcNAc(b1-3)[GlcNAc(b1-6)]GalNAc,"['flexible', 'flexible', 'flexible']"
Oglycan_core5,GalNAc(a1-3)GalNAc,"['flexible', 'terminal']"
Oglycan_core6,GlcNAc(b1-6)[!Monosaccharide(b1-3)]GalNAc,"['flexible', 'flexible', 'terminal']"
Oglycan_core7,GalNAc(a1-6)GalNAc,"['flexible', 'terminal']"
Xylogalacturonan,Xyl(a1-3)GalA(a1-4)[Xyl(a1-3)]GalA,"['flexible', 'flexible', 'flexible', 'flexible']"
Sialosylparagloboside,Sia(a2-3)Gal(b1-4)GlcNAc(b1-3)Gal(b1-4)Glc1Cer,"['terminal', 'flexible', 'flexible', 'flexible', 'terminal']"
LDNF,Fuc(a1-3)[GalNAc(b1-4)]GlcNAc,"['flexible', 'flexible', 'flexible']"
OFuc,GlcNAc(b1-3)Fuc,"['flexible', 'terminal']"
Arabinogalactan_type2,Araf(b1-6)Gal(b1-3)[Araf(b1-3)Araf(b1-6)]Gal,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
EGF_repeat ,Sia(a2-3)Gal(b1-4)GlcNAc(b1-3)Fuc,"['flexible', 'flexible', 'flexible', 'terminal']"
Nglycan_hybrid,GlcNAc(b1-2)Man(a1-3)[Man(a1-6)Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Arabinan,Araf(a1-5)Araf(a1-5)[Araf(a1-3)]Araf,"['flexible', 'flexible', 'flexible', 'flexible']"
Xyloglucan,Xyl(a1-6)Glc(b1-4)[Gal(b1-2)Xyl(a1-6)]Glc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
Acharan_Sulfate,IdoA2S(a1-4)GlcNAc(a1-4)IdoA2S,"['flexible', 'flexible', 'flexible']"
M3FX,Xyl(b1-2)[Man(a1-3)][Man(a1-6)]Man(b1-4)GlcNAc(b1-4)[Fuc(a1-3)]GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
M3X,Xyl(b1-2)[Man(a1-3)][Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'terminal', 'flexible', 'terminal']"
1-6betaGalactan,Gal(b1-6)Gal(b1-6)Gal,"['flexible', 'flexible', 'flexible']"
Arabinogalactan_type1,Araf(a1-5)Araf(a1-3)Gal(b1-4)[Araf(a1-3)]Gal,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
Galactomannan,Gal(a1-6)Man(b1-4)[Gal(a1-6)]Man,"['flexible', 'flexible', 'flexible', 'flexible']"
Tetraantennary_Nglycan,GlcNAc(b1-2)[GlcNAc(b1-4)]Man(a1-3)[GlcNAc(b1-2)[GlcNAc(b1-6)]Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'flexible', 'terminal']"
Mucin_elongated_core2,Gal(b1-?)GlcNAc(b1-6)[Gal(b1-3)]GalNAc,"['flexible', 'flexible', 'flexible', 'flexible']"
Fucoidan,Fuc4S(a1-2)Fuc4S,"['flexible', 'flexible']"
Alginate,L-GulA(a1-4)ManA(b1-4)ManA,"['flexible', 'flexible', 'flexible']"
FG,Fuc(a1-2)Gal(b1-2)Xyl(a1-6)Glc(b1-4)Glc,"['flexible', 'flexible', 'flexible', 'flexible', 'flexible']"
XX,Xyl(a1-6)Glc(b1-4)[Xyl(a1-6)]Glc,"['flexible', 'flexible', 'flexible', 'flexible']"
Difucosylated_core,Fuc(a1-3)[Fuc(a1-6)]GlcNAc,"['flexible', 'flexible', 'flexible']"
GalFuc_core,Gal(b1-4)Fuc(a1-6)GlcNAc,"['flexible', 'flexible', 'flexible']"
DisialylLewisC,Sia(a2-3)Gal(b1-3)[Sia(a2-6)]GlcNAc,"['terminal', 'flexible', 'terminal', 'flexible']"
RM2,Sia(a2-3)[GalNAc(b1-4)]Gal(b1-3)[Sia(a2-6)]GlcNAc,"['terminal', 'flexible', 'flexible', 'terminal', 'flexible']"
DisialylLewisA,Sia(a2-3)Gal(b1-3)[Fuc(a1-4)][Sia(a2-6)]GlcNAc,"['terminal', 'flexible', 'terminal', 'terminal', 'flexible']"
"""


def motif_list() -> list[tuple[str, str, list[str]]]:
    """(name, sequence, places) of each motif."""
    rows = csv.DictReader(io.StringIO(MOTIF_LIST))
    return [(r["motif_name"], r["motif"], re.findall("terminal|internal|flexible", r["termini_spec"])) for r in rows]
