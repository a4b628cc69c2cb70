"""Licence notices and texts: label, text, key phrases that must all stand in it."""

from __future__ import annotations

NOTICES = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "licensed under the MIT License", ["mit license"]),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license", "2 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("bsd", "licensed under the BSD License", ["bsd license"]),
    ("cc0-1.0", "licensed under CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("all-rights-reserved", "Copyright. All rights reserved", ["all rights reserved", "copyright"]),
]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)

TEXTS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use", "are permitted provided"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["permission to use copy modify", "is hereby granted"]
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["apache license version 2 0", "in compliance with the license"],
    ),
    ("gpl-3.0", _GNU.format(name="General Public License", version=3), ["gnu general public license", "version 3"]),
    ("gpl-2.0", _GNU.format(name="General Public License", version=2), ["gnu general public license", "version 2"]),
    ("lgpl", _GNU.format(name="Lesser General Public License", version=3), ["gnu lesser general public license"]),
    ("agpl-3.0", _GNU.format(name="Affero General Public License", version=3), ["gnu affero general public license", "version 3"]),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license", "2 0"]
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ["permission is granted to anyone", "redistribute it freely"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        ["permission is hereby granted free of charge", "any person or organization obtaining"],
    ),
]

#: Short openings of the texts above, as files quote them.
OPENINGS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        ["permission is hereby granted", "without restriction"]
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use", "are permitted provided"]
    ),
    (
        "gpl-3.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        ["gnu general public license", "version 3"]
    ),
    (
        "gpl-2.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
        ["gnu general public license", "version 2"]
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "hereby granted"]
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]

TEMPLATES = NOTICES + OPENINGS + TEXTS
