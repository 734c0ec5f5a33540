"""Digests of the canonical forms of whole licence texts, by SPDX name: real files, with and without titles,
flowed and wrapped at 60 to 100 characters (a line that begins with the word copyright falls out of the canonical form)."""

FULL = {
    "Apache-2.0": """
        4c6e317f52b13dccc5c775e26cc6d6b5 5d21db9df0a659189b7aace1dc3df9b0 80fd9072ff3abaac5ce5940ef25ed199 9768e9ac0a2ddb298695e7c2ca9bfa36
        db4fae888ce4068810986a16e5953e7a ff27ba34e8ac36ddab0cbf04160132c5
    """.split(),
    "BSD-2-Clause": """
        05c3fa6826651b081fb1fb9e5f36d672 05f8e0d46c8f26257722c97ad912411d 07da8ab60ecceb4b61bbcce52f6287b6 0e01e5288c13f198c336c5d2ffac8872
        0e03547c1790ea2c40e8527ea12fb9ea 0eb42c6df37bd02b38d1905e2547d852 108e716930d85861e1a3876e3c767dd7 12ace0413c53a01327d9fe6e859f8b03
        1591c72d99d6995ba21c01463963ff10 15e8edd6533204349d624127209288ef 1861aa5e650030a606b82b2f8d390297 1a5f2da2a22a7bc58c98ca2b66529b8e
        1b5cabda15d5b7832f3484d7e0ced75d 1e6b0a6c0c4c1fcabd0fd97848559714 2132e8173a4f2495edf57d800879743b 2515f517cd04f7e7635c3f415ee9d608
        25621e3c209af7606e9944e4e5b46513 274367c6afc92a76019e4418d58f2e46 3108c9b22ba7079467a064bd9b2b18ab 325abb3f1dec92afba041428b9e22768
        33dba7552287298c4a24a66ae521afac 33ef0078cc1633ff3e2c58aaa92d2900 35140c8b495052cc851885e4844e7c0b 35e81e518f175e90fb69c9d78327cdbe
        361709527a6663502255f3bf100f01a9 369be0093b2fc63b152c6b08433d7381 37693366dbd5b342ccca08c7735b65d0 3a844dd08d45c7ee2280d2d20551c706
        3ace1c3d414bf9e6b9b95525113dc308 3b6096e5fa9beabf72d62df1b88411f2 3b8eff87de6931e01dca5ba8cfb2c05c 3d94ed5a8b81b5b42e2e2870c9ab6d24
        3df0e91458e430a48c745b977bf59551 4992cbb822ce958ce2075fb7f93eaecc 4bc1af6c2e19f36473f3136dccb8f826 506ab38ea4fb0192b54d6096d06472a3
        5119fe9113074de86bb19998bec81fa2 51d69cd7c240263ba1b74d5fd087cc2d 51df3bc4a953232667ab471ac4adf357 529b9cc0bc4f90d540142eb8291ce7f9
        53b049aba5c641306d9855b28dd3c433 54114c046081f2eb45705a488311034e 56581e1d922f26c56b1d4210ebff6959 57ecabf348f16d0a3752bcf0837a333b
        58dd0e66d24d2718ff799f08f8e29eae 6642b0d99e1360b3352c283f9a6d528f 6870bfaeacd4dbcc6157a9c77c706df0 6ac768c0150e4d1f48e8730a89a679de
        6b9a047158e33409830612ce203a7624 6df59a2b22047c1d83151dc306ec98f1 6e90afbda6dd670082c1aa8b61caec09 7156097767f5afef1724228b3dfb48fe
        72c6420c7147cbc35049fbfc2e99d53c 739934792014bccc81ccd463ba43dd79 74e49317c87c313accad978065f53b4c 7733ce47950c88e38fa6d6854b9ce137
        798aeb176fd464e04537aff2c35c84ab 7ae6d876e7e95c9307946ed6cb1705f5 7d5ce6cdae1672cea0f498a4b3e144d1 7e4dbfbb5c3a5b6cf130d9130dda9074
        81e7eb59a86aa5209bbb352dc454cd47 846990a2142126b8d2f70b4bf8a1f77d 84bcc064395e7276bffdd0a37f6b3990 86f56c47a776acba8d7b43470d449555
        87dfec7ca59a2fc6754c489d176f885b 8c19b192342f336853fe3904a8a03dc0 8c8d083911355c4796f5f068e1b6b880 8ddfc8ca1ee321bf3abd27bff4cb7e76
        90af67d7512321b03d5c8f9814e2ad03 914d3f29c55969590f77339cafbef77d 91e4ed12051332d53a432f6d04669bcd 93624f83b994ef4e8b792417c134acb1
        963a300781186ce226d2c2a2e2d97ef8 9bd8f8d33231968fec38f173d7f9012d 9c5a3f893797214ed9093fae998d63cf 9f9962ab98a42b4004ece981910e78b9
        a6a7ac8753591100e9763c645c852f48 a6e4c028125f799b6b72cfc92c4e1759 a7741fd8f2896ca807560f869e89328d a896070cb44f5f722565e8f193b41595
        ab62fe17dd8dec6f25947e7039e19add ae4953f0c3aacc1c9d695607a32a9fe9 af370e9027053224f0dab7428f9ad261 b0538ec125cafeeb58bf11083985630b
        b0a3df48249da3f07a22f277f782d025 b352f832f96d83e846e59fba8ea05e05 b3edfdd8c43c6d4497fd349e268d3a3e b900bd460588b217031fd0926bd88b9b
        b9c504028481e2d2ecf3b0be6f6c3c10 bc35cab03f1fefcaa587de16c5531aa1 bdf5f9e9eb44e5cf3b4f9af234ac3a61 c04c2a131118f71c007e103e1ede2b7e
        c47cda7b8f803f7a1f0bd206f59278e4 c4d302a720dd210af52fceefd9f645af c5bb135b84fd87adbf9f8753fc165299 c9ab8bca8218181f2900261f316bc645
        cb4db83edb06ab951760f8e74d4da171 cb5d21357d71d1080e03d5ce703290cf d08e6b9f3a4426bbbc8b653fb1aacb6d d29725afba2f1f2c430a035821ac91ae
        d2dcd0e5e48c0aaff2bc784dd15a4e08 d4a0682cfd74fd2214d6d189dda1b165 d603a6c90c1de50074a607ad34a35274 d67ca2797106fb8290b119d207d76508
        d6c17dea09d736abebcdc7339657bd56 d9407186f280e05d2a0e742ca1ea8893 da6ca31038fa701ebd963783197b02c3 dd1a938d7ffd05e2b234515773b5cfbd
        de93783ce5e9b4228c96966b1a0fec58 deb73be0153546201ff674d12319f65c e085429109497ff6e1ba9fe55c13795a e0e38292556dd12e0141e56d0edd3a37
        e28ceb3be18414bf56d4a757c9612785 e594ac856360a77fe1214ea07e0bfc37 e83f898fec975244875d3b3914edd775 e84ef3403fb3c1e6316f281979008ac1
        e8fddfbbcb2712e1ec88d0ec9d25f2ae e92b37038b47972a44013741351d9500 eba73fc499aec7f268a9bad1aed3eb57 efd96af4a3cb02755537130440c2e046
        f170b2e240892a39f97ec6421f080d7d f50ee0981c37d936b8e6afda7be52d9c f887eadc39f95cbb3af36968db2aefb0 f9ebd3414f2313e92c445dfd5fd2ef30
        fc57366ae46026d44386bdc1d9001091 ffcaf66d202d18fcab56946f0ffe7ed2
    """.split(),
    "BSD-3-Clause": """
        0046a30e488a3b508ab7056aeb37712c 009e52dc07fe9475500bd59f504750a5 01847766a9abe962c39ca1a86931961a 0464885b49707ed35477366280adca0b
        061e42dde620a15cfbb11a3422c85f68 0c05d62772af8cd8bc67bcd625470af7 0c561318f16cb4866c2610c507e7e89e 0dc33942c100294a1fd49832854c8b1f
        0dfe98f7d4d016ae29fab953f8d4464e 1187e6820b59742f7c62f1bf9e8ec91a 150a0101981ef7ecd2739273fc88708b 17c50fa0ea3c6eb44be6a40d25ebf165
        18c4bd557c7bb1306bde881f62b428c4 19d9f40db6a557bcfaac410dc475744a 19f09169303d7b883e56ede107b7ec94 1ff9dfbaa16db3852c07e533f5a50ef9
        2031ee10c4e800d8a98c6fb2a6c4ad90 2104595fb49013879011a1c2759da668 22eb9b39d0ede00cbb3e4bbd70588236 246dec098e5d378fa3ab0b755b70bf17
        2663adc6779ae6187ad5446a34368c14 2abb6b187f58fcd7fa694c5008f4843f 2e3352cd0ed97850e95e026670943ce0 2ed470f057ef25cf32d58563a14ca55f
        3869bcb1fb59424636df4a591df44161 38773794d6f67883595bdba5d92ef90a 3e0d86249900485651a2fad31e0fc294 3f17b3d5fca872ee00732006ae968f45
        3f52c82b84ad93fa724c3c649c87c49c 3f85142d882957b4e49da77463563ad7 3f8b91345e977dc62312302aa4b7b338 40b01e5eb8a08d44f638f5258c58ae3c
        411bf1e4d3c557480992f69628c84d0c 4235c81cbb3cba29e397c80f103ae949 426c6da690d9a30230b8f12976311f4f 4403d599b6a0a1a715f3cb7be07d31f2
        47a5de4fddb43361321f02784caa0962 48beb912ae7759e1065142257cc0edd5 492b720389520bc20eb089d4163dad16 4a2af7c31a495a3dbe98114619c70994
        4b10e90ae95fd3f7b4c9196625f3a873 5198c8a07b7d4cde55753db634a5b2c0 51dc1b12906b8491ac514a6d7a860316 5624dec2bc580aadf62ad2fb354f8bf6
        586333a8943adefcee64f671d13e4cd9 59313bc732675fa3cfe73e225a07e6b4 5a6936ed2598b057340994d820a07742 5caef62ff653df6be8ed03eb89d2dbb7
        5f286ded6802ce0c5f00418828b3cc5a 607dfcf19e7b38858ad7b50b281db4ed 60e70a1510438ea373c1afdb8d3d6437 63209594d7010179ecafdd05012124af
        64421184de52ba6b114066816a09118d 67b448452cbf3aef6be6cb731ad276d5 6a16a8564718dbc4eced61d220eeb38a 6a28b86b1b31d438d804f8785bba36d2
        71bee95f2d622a0e99cc68ce2cb641f2 72a02864108c5ba5bebb1759c3bc0d2b 747b9537a4cefe6cbf5202a59e7b1271 7482381f4c5b02ccc8cc79017838f0b5
        76e857eb3297a0a26ecaee4fd08504f4 79b4d0ecc76897227f3183f14b94e742 79eac4a8b48a8f516190959efe4b92f8 7cdebc183a04af234da3fa3abb9af80c
        7cf93762d2637a0821b168d681eeff86 7e0af0339918b7c9f7523a1ba20fd8a5 7f841113b989c87e3719c810a67f75ab 8186eb4736e862df5037be03e93e7749
        84f9a5bd7098372071bb0e2b4c7fb92b 88db08fe584ee758d4aa4a2169e2b818 8f39d4767d0132f590471b31cb23fbe2 936437b03e2688f008001c0a28571875
        98d214dd1f57d1e5e0d79216b9854e5e 9aaa46622f11380ebe33fb53add87c9b 9bbd7db5d381a6fe317fecadf6729d92 9e31cd58da7b6bec514f81b4686041dc
        a39a939ee5193d8a4c3998c3860b8827 a3dfa0e57be91d416230e72f660ed479 a5d69055732ccfdc39dbc9f0fa88dec1 a8694c957f87ef4c03b170e19d529811
        aa2ebb685324d9899923c2f1cf692ecb ab40f6973596403edb3aea9575312fe7 af8481f0f1f48f1429491f8f20b9552b b1b6426c1ed81732a0f149eb68d123f8
        b1c3d0152c8ec46ca688360c01ee656b b3f429ec7e511d7aafc2ae22744244f4 b6b6bbba2fa9bbaca89597d99c84f92a bcc3f5b150b583800cb8ea0093da9bce
        be14605ae333059add0ebf78bc4799af c07b63c3641413eaa69a69de2d8bc5af c245a9d439da9a8ea626ab19c280d998 cb2ba037ed147c166a23f8214be7a47e
        cda42de2852ba3ebfc4947b4aaf81e1f cdb01cd975206bafce44a8e6be66c7b1 ce68edc99871dcc412dce50d8d5c3a91 cf57f4b0f62a92bdb7fa7b18b8095bb5
        d15a2eb26ff73369758fa6f3cfce36b7 d4cef4d9ad8054ea8d2cc83477a6f637 d5a9bb4e4e78da983b8bbd00efc69183 d6579e71b3b81888b0f75e42dea7ba91
        d7cf76c0a8f6f2e83ba8f324275169e2 d943e326851d74b1d0eb822d7afc67f7 dbcc6b46cd5b3ad519ba6d13a4021fcd dc7a19a03372e3689921e61fa9642efc
        dca41b092a1e34c729fbfb872ff1e6de dccfb99c16f205cac7a293510ecbd47a def1af1a2553cd0e283155d4507b6608 dfa0f193afd154cde48bb7d29d2df9fd
        dfd9463b7bcad50bb1270be3d6bf0c2a e28eb0a989f3d0d112480a3905886d91 e2d25fe8ba2c241363e7a7c2c8741a6a e6cf2a8f6ad77872429f5987454eea97
        e82046f0b7f72505ecac75064a0d3ab0 ea635c2dc374bc1facae8823c6e6c031 ecdfc863bdafb070ae0e755058a79a5a f4bceb6c56b7c1c978c713cfaca5d16a
        fb49406903199dc4682c1345e2b0316e fbfac06d2025928cc99f71b4fac23bb6 fda5d0035067d21f2e6c85bfc3567343 ffb26b27220b2f421e0ba6da88d6db4b
    """.split(),
    "BSL-1.0": """
        ac2afa4a98b996b77ea9e51a8c904ee1
    """.split(),
    "CC0-1.0": """
        93a180096f6cfcf2c0dd24f75c2eec48
    """.split(),
    "GPL-1.0-only": """
        3aecf3f85b2a7e1cf719c688a1c214fa bbc56cff7140c8c3cd4b868fb25de455 dbf3c47f5a8f127e58d08cabc1ebb916 e64afbb3eb9ed9907294af675f791aba
    """.split(),
    "GPL-2.0-only": """
        b8444fd08fb20cd8d245a1c56739b50b c87461d4dc2703de84305277d25c82d8 cbb3451938de95cbb302d3c10690ede8 e374d0b43c25aed1a2b28951fe92a546
    """.split(),
    "GPL-3.0-only": """
        3d166aeeeb2ec1fea896f0a01f69dc5c 911c13fc9d0f569481e5c351a7c4f103 bd039204ce02cc48d84a430c9c382f0b d3248661bfe810c3d556f94c500bddfb
    """.split(),
    "ISC": """
        63179b48dd80764d198b18b1a4a65df0 9b4f6eddda8e34fea1fe9420ebff490a a28e0523130ff62bda5b02d13cbabb55 b6ab23f33a368e7f225abed7065c8009
        c22af3909cee7fd7bba39db6020b278e c8a67b9a4b1a8aa30b1dd65368c84f80 dcd69494c56e26e8a04f3d6c3be6ff7a e8e1ea32eea60e02907d9d691a4153eb
    """.split(),
    "LGPL-2.0-only": """
        1389f4e6c9257fffaaa58a4ba72e4209 53c7c83fea2ab2dfecbf363917d53a22 7d054715126defc8a18808a6934f14a4 999f5b95aaa9362eae0bf3cb0eb7581c
    """.split(),
    "LGPL-2.1-only": """
        519c5306e9399a753b0e3b10cc3f1fbd a40966c05dddcd43bfccd88fd4e2cfe7 b438fe0ce082f3615cf69a492dbc792f ea4739ccf5314c5f636f979cc03259e2
    """.split(),
    "LGPL-3.0-only": """
        087dc82eb7c367aa4297b1f0bb1c2c21 b31b7335bc37919e8cdd79154e04d88d
    """.split(),
    "MIT": """
        04ddd61083899c2a5ef03d9fe09b79c9 0654809a643792890ef9ad53036c8531 1ee5a45ddec850442e4e42ddbf139f2b 267835a5b13808cd084b9abe3f2a1877
        2886eb256547eeebf28ce83cd96be3dc 3081e53379d25b70c18f415d2a97fb5c 3f7ce81dd6ea43e9da04c91e6d46bc7c 42b1183431880a33590cc63ab4738953
        5fefeb84c2e262528a30c16c8f8d7a34 62aa9b5365dd6b66b343cf1084647c8a 66dd1caf442553ce09fa72a9da2e8c0e 90a17991c3ba7b04d183a6467fbe3449
        a22a6a19d4d5e9eda21ebba2a31ae56a a6e9fe4bea13287f5038fd9cc6844c9c ae1a4e26b16cef2df999f78fbb978fcf b2de85e2ec459a7a83c025107bfe9080
        c57c00559ef795f4117fb4825213e0ef d4c5f5a0da3d27e3a9dc10ef25e034f7 e81be6942f0fb4736b639a8d886d078f f3337087707816eadb4c727b81399a58
    """.split(),
    "MPL-1.1": """
        a708f02208e9c42d3644490185833425 c905b45bc12f5defb141a18d2fe18d47
    """.split(),
    "MPL-2.0": """
        04f1aa7265a0b508cecbfab9de83b56c 35fb4d2625087f7fd780039aa7b4ebb2
    """.split(),
    "Unlicense": """
        05df95129104775b75c79f08fdd38180 0ddb544fc94f1ac376b1b27618cf995a 2bbfee96e397c4bc296397856b4bccf8 a1dfde39ef8fa1f64db9cdb8dda02429
        a8ec4f7d882021713cd0e5ffceba3397 aefb49d51ebec48a32c4f8cfec658707
    """.split(),
    "Zlib": """
        6df2a895c31891fec159c01a49b2d3cf c8509dae8dc0557bb29ef1c77b16975c da06f469fac496b82b7382c5e2ebb216
    """.split(),
}
