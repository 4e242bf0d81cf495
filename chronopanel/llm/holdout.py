"""Pages checked by hand: what each holds, and its text. They calibrate the classifier of quality.py."""

HOLDOUT: list[tuple[str, str]] = [
    ("prose", "The river rises in the hills above the town and falls quickly to the plain. Its water is clear in spring,\nbut after the autumn rains it carries a good deal of sand. Two mills were built on it before 1800."),
    ("prose", "When the valve is closed, the pressure in the chamber rises until the spring\ngives way. The student should explain why this takes longer in cold weather.\n\nThe same holds for a second chamber of 40 litres."),
    ("prose", "1. Find the speed of the cart after 5 s if the force stays at 12 N. [4]\n2. Explain in your own words why the cart does not stop at once when the force is\nremoved, and name two ways in which the distance could be shortened. [6]"),
    ("prose", "We measured the length three times and took the mean. The results are in the table.\nTrial | Length\n1 | 30.2\n2 | 30.4\n3 | 30.1\nThe second value was the largest, though the difference is within the error of the scale, and it was\nkept for the sake of completeness."),
    ("prose", "Es wird angenommen, dass die Temperatur im Behälter nicht steigt. Dann ist die Kraft auf den Kolben\nnur von der Dichte abhängig, und die Arbeit kann aus der Tabelle bestimmt werden."),
    ("prose", "La pression dans la conduite est donnée par le tableau. Il faut montrer que la vitesse dépend de la\nhauteur et que le débit reste constant pour chaque essai."),
    ("prose", "La fuerza no puede ser mayor que el peso de la viga. En esta sección se calcula la presión que actúa sobre\nla pared y después la densidad del fluido."),
    ("prose", "A velocidade da água não pode ser medida sem o tubo. Nesta seção estudamos a pressão que age sobre a parede\ne depois o calor que se perde no sistema."),
    ("prose", "यदि पानी को तह उच्च भयो भने दबाब पनि ठूलो हुन्छ । यो अध्यायमा पानी र प्रवाह को बारेमा पढिन्छ ।"),
    ("prose", "Thus h = 20.5 / x. As the beam bends, its lower edge is stretched and the upper edge is pressed\ntogether. Hence v = 3 y and the load that it bears is about 48 kN."),
    ("prose", "It was found that the seal leaks."),
    ("prose", "the flow of heat through the wall is slow.\nNo rule of this kind is known for liquids,\nand none has been sought by the engineers\nwho built the first plant at the harbour."),
    ("list", "Contents\n1.1 Beams and columns\n1.2 Arches\n1.3 Heat in solids\n2.1 Flow in pipes\n2.2 Pumps\n2.3 Losses at bends"),
    ("list", "Apparatus\n- retort stand;\n- glass beaker;\n- steel rule;\n- thermometer;\n- cork mat;\n- copper wire."),
    ("list", "Topics covered\nDensity of solids\nViscosity of oils\nLaminar flow\nOpen channels\nPumps and turbines\nWater hammer"),
    ("list", "(a) voltage of cell,\n(b) current in branch,\n(c) internal resistance,\n(d) copper loss,\n(e) iron loss."),
    ("list", "Unit 3\n• thermal pump\n▪ gas turbine\n• slide valve\n▪ flywheel\n• governor\n• steam chest"),
    ("list", "1.1 Strength of alloys: hardness test, creep, fatigue limit\n1.2 Polymers: glass point, fillers, moulding\n1.3 Ceramics: sintering, slip casting, glazes\n1.4 Composites: fibre lay-up, resin transfer"),
    ("list", "Reading list\n1. Smith, Theory of Plates\n2. Maro, Channel Hydraulics\n3. Oduya, Rotor Dynamics\n4. Lindt, Circuits and Fields\n5. Pereira, Soil Tests"),
    ("list", "absorption\nbearing load\ncentre of mass\ndamping\nelastic limit\nfriction head\ngear ratio\nheat sink"),
    ("table", "Unit | Reading | Marks\n1 | 20.5 | 3\n2 | 21.7 | 4\n3 | 19.9 | -\n4 | 22.0 | 5"),
    ("table", "Table 4: slip of belts\nTrial;Load;Speed\n1;40 N;3.2\n2;55 N;2.9\n3;70 N;\n4;85 N;2.1"),
    ("table", "Name    Hours    Result\nbrass rod    4    12.6\ncopper rod    5    11.8\nsteel rod    4    14.0\nglass rod        9.1"),
    ("table", "No.\tName\tMarks\n1\tOskar\t34\n2\tLoma\t41\n3\tVidal\t29\n4\t\t38"),
    ("table", "--------+--------+--------\n| 1  |  rotor damping  |  33 |\n| 2  |  -  |  35.1 kN |\n| 3  |  soil and sand  |  20 |\n| 4  |    |  7 |"),
    ("table", "Chapter | Name | Name | Load\nsteady shaft | closed coil | heat of slip | weir head\ncuring and gain | thin plate | moist soil | 20 kJ\npolymer | rough wall | field coil | open pump"),
    ("junk", "%&/ ==<> §§#+ ~~\\_ |<> ^^°# ++*~\n#=% &&§/ <>|~ °^_= *#+~ \\§%& =<>|"),
    ("junk", "xQ3vT Bn7kkR pump 9zLLw mGt4X rotor Vb2 qqWz8 kJ5tN\nTr6Gh bbQ1 sLp9 vX flow dRz44K wPq hh7T mZ3 nNb0c"),
    ("junk", "Ã¤Â°Å“ â€œÃ©t Ã±Ã¼r ï¿½Ã¤s Å“â‚¬n â€™Ã±s\nÂ°Ã©Ã¤n Ã¼â€œs ï¿½r Ã±Å“Ã¤t â‚¬Â°Ã¼s Ã©Ã±r"),
    ("junk", "� �c �y d� y�d �� z� �x\n�� bz � x� d�b yc �"),
    ("junk", "jjjl i||I 'l`t ,.I1 |tj! ft`l I1i| r|.j\nl|I1 t!fj |`lI .,j1 iiI| rt|l !I1` jf|."),
    ("junk", "    \n  beam  "),
    ("junk", "zzkt prrw dmnb xlq vvch tkkz wrrp bnmd qlx the chvv ktzz prwr\nmbdn lxq chv tzk wpr ndmb and xql vch zkt rwp dbnm qxl"),
]
