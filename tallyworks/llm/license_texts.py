"""Notices by which licences are recognised.

Fixed values: (label, words of the notice in lower case, mandatory key phrases).
"""

NOTICES = (
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", ("with or without fee is hereby granted the software",)),
    ("afl-3.0", "licensed under the academic free license version 3 0", ("academic free license",)),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation", ("apache software foundation",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document the artistic license 2 0", ("artistic license",)),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form", "above copyright notice")),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "endorse or promote")),
    ("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation covered",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("extent possible under law", "neighboring rights")),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ("under the eupl", "european commission")),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", ("gnu free documentation license",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("is hereby granted provided that", "appear in all copies")),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("lesser general public license", "version 2 1")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software", ("accompanying software", "you accept this license")),
    ("odbl-1.0", "this database is made available under the open database license", ("open database license",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("open font license",)),
    ("psf-2.0", "psf is making python available to licensee on an as is basis psf makes no representations or warranties express or implied", ("psf is making python available",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("wtfpl", "do what the fuck you want to public license", ("you want to public license",)),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ("altered source versions", "plainly marked")),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable", "arising from the use")),
)

#: Words that are never indexed: too frequent in any text.
COMMON = frozenset(
    """0 1 2 3 4 a above all an and any are as at be being by can conditions copy do document either for form forms free from has have http if in include included
    is it its law list made make may must name names no not of on or original other person products program provided public related released rights see shall software
    soon source specific such terms that the they this to under use used using v version versions want what will with without work www you""".split()
)
